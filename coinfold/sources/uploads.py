"""An uploaded file to ledger rows: its layout picks the parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import KNOWN, token_registry
from . import exports, wallets
from .files import detect_layout, read_export
from .solana import parse_solana

#: Parsers by layout; each takes the rows, the file's name and the token registry.
PARSERS: dict[str, Callable[[DataFrame, str, DataFrame], DataFrame]] = {
    "kraken": lambda df, name, tokens: exports.parse_kraken(df),
    "exchange_ledger": lambda df, name, tokens: exports.parse_exchange_ledger(df, name),
    "cosmos_wallet": lambda df, name, tokens: wallets.parse_cosmos(df),
    "cryptocom": lambda df, name, tokens: wallets.parse_cryptocom(df),
    "woox": lambda df, name, tokens: exports.parse_woox(df),
    "variational": lambda df, name, tokens: exports.parse_variational(df),
    "solana_wallet": lambda df, name, tokens: parse_solana(df, tokens),
    "evm_wallet_csv": lambda df, name, tokens: wallets.parse_evm_csv(df, name),
    "generic": lambda df, name, tokens: exports.parse_generic(df),
}


def parse_upload(spark: SparkSession, path: str, tokens: DataFrame | None = None) -> tuple[str, DataFrame]:
    """The layout of a file and its ledger rows. Without a token registry only the known mints have tickers."""
    df = read_export(spark, path)
    layout = detect_layout(df.columns)
    known = tokens if tokens is not None else token_registry(spark.createDataFrame(list(KNOWN), "mint string, symbol string, name string, decimals int"), with_known=True)
    return layout, PARSERS[layout](df, path.rstrip("/").rsplit("/", 1)[-1], known)


def preview_upload(spark: SparkSession, path: str, tokens: DataFrame | None = None) -> DataFrame:
    """One row (parser, source, n_rows, date_start, date_end): what an import of the file would bring, without importing it."""
    layout, rows = parse_upload(spark, path, tokens)
    return rows.agg(F.lit(layout).alias("parser"), F.mode("source").alias("source"), F.count("*").alias("n_rows"), F.min("timestamp").alias("date_start"), F.max("timestamp").alias("date_end"))
