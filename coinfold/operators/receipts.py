"""Liquid staking across rows that an import left apart: receipts before a sale, coins that come back after one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import staking
from .duplicates import LIQUID, liquid_sales, near, without
from .pairing import earliest

NATIVE = ("SOL", "WSOL")
# Native coin sold beside a receipt is a fee up to this value and this part of the receipt's.
DUST_VALUE = 15.0
DUST_PART = 0.08


def _legs(x: DataFrame) -> DataFrame:
    """Rows as legs to pair; on-chain ids mark them, null and empty ones agree with all."""
    return x.withColumns({"at": F.unix_micros("timestamp") / 1e6, "mark": F.coalesce("on_chain_tx_id", F.lit(""))})


def sale_inflows(ledger: DataFrame, liquid: tuple[str, ...] = LIQUID, chain: str = "solana", seconds: float = 3600, tolerance: float = 0.005) -> DataFrame:
    """Sales of a staking receipt with the earliest unused transfer in of the same token and size in the hour before."""
    x = ledger.withColumn("asset", F.upper(F.trim("asset"))).where((F.col("source") == chain) & F.col("asset").isin(*liquid) & (F.col("amount") > 0))
    into = x.where("transaction_type = 'TRANSFER' and transfer_direction = 'IN'")
    return earliest(_legs(x.where("transaction_type = 'SELL'")), _legs(into), seconds, 0, tolerance)


def unstake_receipts(ledger: DataFrame, liquid: tuple[str, ...] = LIQUID, native: tuple[str, ...] = NATIVE, chain: str = "solana", seconds: float = 900) -> DataFrame:
    """Sales of a staking receipt whose group has no purchase of the native coin, with the next unused transfer in of that coin."""
    a, t = F.upper(F.trim("asset")), F.col("transaction_type")
    settled = ledger.where((t == "BUY") & a.isin(*native) & F.col("trade_group_id").isNotNull()).select(F.col("trade_group_id").alias("_g")).distinct()
    x = ledger.where(F.col("source") == chain)
    sales = x.where((t == "SELL") & a.isin(*liquid)).join(settled, F.col("trade_group_id") == F.col("_g"), "left_anti")
    into = x.where((t == "TRANSFER") & (F.col("transfer_direction") == "IN") & a.isin(*native))
    coin = F.lit(native[0])  # receipts of all kinds compete for one coin
    return earliest(_legs(sales.withColumn("asset", coin)), _legs(into.withColumn("asset", coin)), 0, seconds)


def _bought(ledger: DataFrame, pairs: DataFrame, sale_currency: bool, counter: Column) -> DataFrame:
    """The inflows of `pairs` as purchases at their sale's value, in its group."""
    sale = ledger.select(F.col("id").alias("out_id"), F.struct(F.col("fiat_value_at_trigger").alias("value"), F.col("fiat_currency").alias("currency"), F.col("trade_group_id").alias("gid"), F.upper(F.trim("asset")).alias("coin")).alias("_s"))
    x = ledger.join(pairs.join(sale, "out_id").select(F.col("in_id").alias("_in"), "_s"), F.col("id") == F.col("_in"), "left")
    hit = F.col("_s").isNotNull()
    put = lambda new, c: F.when(hit, new).otherwise(F.col(c))
    return x.withColumns({
        "transaction_type": put(F.lit("BUY"), "transaction_type"), "transfer_direction": put(F.lit(None).cast("string"), "transfer_direction"), "counter_asset": put(counter, "counter_asset"),
        "fiat_value_at_trigger": put(F.round(F.greatest(F.lit(0.0), F.coalesce("_s.value", F.lit(0.0))), 2), "fiat_value_at_trigger"),
        "fiat_currency": put(F.coalesce(F.col("_s.currency") if sale_currency else F.col("fiat_currency"), F.lit("USD")), "fiat_currency"), "trade_group_id": put(F.coalesce("_s.gid", "trade_group_id"), "trade_group_id"),
    }).select(*ledger.columns)


def native_legs(ledger: DataFrame, liquid: tuple[str, ...] = LIQUID, native: tuple[str, ...] = NATIVE) -> DataFrame:
    """In a group that sells a staking receipt, small sales of the native coin are fees; if the group buys none of it, the first other
    sale is the purchase with its direction lost."""
    a, t = F.upper(F.trim("asset")), F.col("transaction_type")
    value = F.coalesce("fiat_value_at_trigger", F.lit(0.0))
    top = F.max(F.when((t == "SELL") & a.isin(*liquid), F.struct(value.alias("value"), a.alias("coin"))))
    g = ledger.where("trade_group_id is not null").groupBy("trade_group_id").agg(top.alias("top"), F.max((t == "BUY") & a.isin(*native)).alias("buys")).where("top is not null")
    sold = ledger.where((t == "SELL") & a.isin(*native)).join(g, "trade_group_id").select("trade_group_id", "id", "seq", "timestamp", "top", "buys", ((value <= DUST_VALUE) & ((F.col("top.value") <= 0) | (value <= F.col("top.value") * DUST_PART))).alias("dust"))
    first = sold.where("not dust and not buys").groupBy("trade_group_id").agg(F.min(F.struct("timestamp", "seq", "id"))["id"].alias("id"), F.first("top.coin").alias("_coin"))
    new = cut(sold.where("dust").select(F.col("id").alias("_id"), F.lit("FEE").alias("_type"), F.lit(None).cast("string").alias("_coin")).unionByName(first.select(F.col("id").alias("_id"), F.lit("BUY").alias("_type"), "_coin")))
    x = ledger.join(new, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return x.withColumns({"transaction_type": F.coalesce("_type", "transaction_type"), "counter_asset": F.when(hit, F.col("_coin")).otherwise(F.col("counter_asset")), "transfer_direction": F.when(~hit, F.col("transfer_direction"))}).select(*ledger.columns)


def liquid_staking(ledger: DataFrame, liquid: tuple[str, ...] = LIQUID, native: tuple[str, ...] = NATIVE, chain: str = "solana") -> DataFrame:
    """Copies of sales go; receipts that come in before a sale and coins that come after it are purchases; what a sale yields beyond
    the principal is income. A transfer out that only mirrors such a coin within 30 seconds goes too."""
    x = cut(without(ledger, liquid_sales(ledger, liquid, chain)))
    x = cut(_bought(x, sale_inflows(x, liquid, chain), True, F.lit(native[0])))
    x = cut(native_legs(x, liquid, native))
    pairs = cut(unstake_receipts(x, liquid, native, chain))
    coin = F.upper(F.trim("asset")).isin(*native)
    out = x.where((F.col("source") == chain) & coin & (F.col("transaction_type") == "TRANSFER") & (F.col("transfer_direction") == "OUT")).withColumn("asset", F.lit(native[0]))
    came = x.join(pairs.drop("asset"), F.col("id") == F.col("in_id")).withColumn("asset", F.lit(native[0]))
    # The mirror is near the coin or near its sale, and always as large as the coin.
    sold = x.select(F.col("id").alias("out_id"), F.col("timestamp").alias("sold_at"))
    echo = near(out, came, 30, 0.02, ["asset"]).unionByName(near(out, came.join(sold, "out_id").withColumn("timestamp", F.col("sold_at")), 30, 0.02, ["asset"])).distinct()
    x = cut(without(_bought(x, pairs, False, F.col("_s.coin")), echo))
    return staking.liquid_yield(x, liquid, native)
