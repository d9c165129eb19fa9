"""Rows that say what another row says already: equi-joins on asset and time bucket, then left anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrichment import EXCHANGES, principal_groups
from .pairing import staking_echoes

# Receipts of liquid staking.
LIQUID = ("MSOL", "JITOSOL", "BSOL")


SIGN = 16  # characters by which signatures are told apart


def _at() -> Column:
    return F.unix_micros("timestamp") / 1e6


def close(a: str, b: str, tolerance: float) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= F.greatest(a, b) * tolerance


def near(rows: DataFrame, others: DataFrame, seconds: float, tolerance: float, keys: list[str], more: Column | None = None) -> DataFrame:
    """(id): rows that have one of `others` with equal keys, a time within `seconds` and an amount within `tolerance`.

    Time is cut into buckets of that length and each row looks into its own and the neighbouring ones. `more` may compare further columns of the
    others, which are named with o_ before them.
    """
    b = F.floor(F.col("at") / seconds)
    x = rows.withColumn("at", _at()).where("amount > 0").withColumn("bucket", b)
    y = others.withColumn("at", _at()).where("amount > 0").withColumn("bucket", F.explode(F.array(b - 1, b, b + 1)))
    y = y.select(*keys, "bucket", *[F.col(c).alias(f"o_{c}") for c in ("id", "at", "amount", "trade_group_id", "on_chain_tx_id", "token_mint")])
    ok = (F.abs(F.col("at") - F.col("o_at")) <= seconds) & close("amount", "o_amount", tolerance) & (F.col("id") != F.col("o_id"))
    return x.join(y, [*keys, "bucket"]).where(ok if more is None else ok & F.coalesce(more, F.lit(False))).select("id").distinct()


def liquid_sales(ledger: DataFrame, assets: tuple[str, ...] = LIQUID, chain: str = "solana", seconds: float = 3600) -> DataFrame:
    """(id): transfers out of a staking receipt that repeat a sale of 2 % the same size: of the same trade group, whatever their on-chain ids, of a
    signature that begins alike, or within the hour."""
    x = ledger.where((F.col("source") == chain) & F.upper("asset").isin(*assets) & (F.col("amount") > 0))
    out = x.where("transaction_type = 'TRANSFER' and transfer_direction = 'OUT'")
    sold = x.where("transaction_type = 'SELL'")
    signature = F.coalesce(F.nullif(F.col("on_chain_tx_id"), F.lit("")), F.nullif(F.col("trade_group_id"), F.lit("")))
    # Each row stands under its group and under the first characters of its signature.
    marks = F.array_compact(F.array(F.concat(F.lit("g"), F.nullif(F.col("trade_group_id"), F.lit(""))), F.when(F.length(signature) >= SIGN, F.concat(F.lit("s"), F.substring(signature, 1, SIGN)))))
    a = out.select("id", "asset", "amount", F.explode(marks).alias("mark"))
    # Of the sales under a mark only their sizes matter, each once.
    b = sold.select("asset", F.col("amount").alias("o_amount"), F.explode(marks).alias("mark")).distinct()
    same = a.join(b, ["asset", "mark"]).where(close("amount", "o_amount", 0.02)).select("id")
    return near(out, sold, seconds, 0.02, ["asset"]).unionByName(same).distinct()


def swap_legs(ledger: DataFrame, chain: str = "solana", seconds: float = 120, tolerance: float = 0.001) -> DataFrame:
    """(id): transfers in that repeat a grouped purchase of the same token within two minutes."""
    x = ledger.where(F.col("source") == chain)
    mint = F.col("token_mint").isNull() | F.col("o_token_mint").isNull() | (F.col("token_mint") == F.col("o_token_mint"))
    return near(x.where("transaction_type = 'TRANSFER' and transfer_direction = 'IN'"), x.where("transaction_type = 'BUY' and trade_group_id <> ''"), seconds, tolerance, ["asset"], mint)


def deposit_rewards(ledger: DataFrame, exchanges: tuple[str, ...] = EXCHANGES, seconds: float = 300) -> DataFrame:
    """(id): rewards that an exchange booked beside a deposit of the same size, the transfer in that stays."""
    x = ledger.where(F.col("source").isin(*exchanges))
    return near(x.where("transaction_type = 'STAKING'"), x.where("transaction_type = 'TRANSFER' and transfer_direction = 'IN'"), seconds, 0.02, ["asset", "source"])


def without(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return ledger.join(ids.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")


def collapse_exchange_noise(ledger: DataFrame, exchanges: tuple[str, ...] = EXCHANGES, hours: float = 48) -> DataFrame:
    """Without echoes of rewards, then without rewards that a deposit left over by that repeats."""
    x = without(ledger, staking_echoes(ledger.where(F.col("source").isin(*exchanges)), hours))
    return without(x, deposit_rewards(x, exchanges))


def without_staking(ledger: DataFrame, exchanges: tuple[str, ...] = EXCHANGES, hours: float = 48, echoes: bool = True) -> DataFrame:
    """The ledger's view without rewards, but those that come with a principal, and without transfers that only echo a reward."""
    keep = ledger.join(principal_groups(ledger), F.col("trade_group_id") == F.col("_g"), "left_semi").where("transaction_type = 'STAKING'").select("id")
    gone = without(ledger.where("transaction_type = 'STAKING'"), keep)
    out = without(ledger, gone.select("id"))
    if not echoes:
        return out
    return without(out, staking_echoes(ledger.where("transaction_type <> 'STAKING'").unionByName(gone).where(F.col("source").isin(*exchanges)), hours))
