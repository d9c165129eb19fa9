"""Reading exports and recognising their layout."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that a layout must have and those it may not have, in the order in which layouts are tried.
LAYOUTS = (
    ("kraken", {"txid", "refid", "type", "asset", "amount"}, set()),
    ("exchange_ledger", {"utc_time", "operation", "coin", "change"}, {"txid", "refid"}),
    ("cosmos_wallet", {"type", "from", "to", "txhash", "amount", "timestamp"}, set()),
    ("cryptocom", {"timestamp_utc", "transaction_description", "currency", "amount", "transaction_kind"}, set()),
    ("woox", {"order_id", "create_time", "instrument", "side", "executed", "average_price", "realized_pnl"}, set()),
    ("variational", {"created_at", "underlying", "instrument_type", "status"}, set()),
    ("solana_wallet", {"signature", "action", "from", "to", "amount", "flow"}, set()),
    ("evm_wallet_csv", {"from", "to"}, set()),
)


def column_name(raw: str) -> str:
    """Lower case, without mark and quotes, words joined by underscores."""
    return re.sub(r"_+", "_", re.sub(r"[\s()/]+", "_", raw.replace("﻿", "").strip().strip('"').lower())).strip("_")


def is_json(spark: SparkSession, path: str) -> bool:
    """By the extension (.json, .csv, .txt); of other files, whether the first line that isn't blank begins an object or an array."""
    if path.lower().endswith((".json", ".csv", ".txt")):
        return path.lower().endswith(".json")
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).collect()
    return bool(first) and first[0].v.lstrip("\ufeff")[:1] in ("{", "[")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON as columns of strings with normalised names. JSON may hold its rows under "transactions"."""
    if is_json(spark, path):
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        if "transactions" in df.columns:
            df = df.select(F.explode("transactions").alias("t")).select("t.*")
    else:
        df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[column_name(c) for c in df.columns])


def detect_layout(columns: list[str]) -> str:
    have = {column_name(c) for c in columns}
    if "time" in have and "operation" in have:
        have.add("utc_time")
    for name, need, never in LAYOUTS:
        if need <= have and not never & have and (name != "evm_wallet_csv" or any("hash" in c for c in have)):
            return name
    return "generic"


def wallet_chain(address: Column) -> Column:
    """The chain whose addresses look like this one; null if none does."""
    a = F.trim(address)
    return (
        F.when(a.rlike("^0x[0-9a-fA-F]{40}$"), "ethereum").when(F.lower(a).rlike("^celestia1[02-9ac-hj-np-z]{38,}$"), "celestia").when(F.lower(a).rlike("^(addr1|stake1)[02-9ac-hj-np-z]{38,110}$"), "cardano")
        .when(a.rlike("^(bc1[02-9ac-hj-np-z]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34})$"), "bitcoin").when(a.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"), "solana")
    )


def number(c: Column) -> Column:
    """A tolerant number: blanks, dashes and words for nothing are 0."""
    return F.coalesce(F.when(F.lower(F.trim(c)).isin("", "-", "null", "nan", "none"), 0.0).otherwise(F.trim(c).try_cast("double")), F.lit(0.0))


def when_utc(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.trim(c)), F.try_to_timestamp(F.trim(c), F.lit("dd/MM/yyyy HH:mm:ss")))
