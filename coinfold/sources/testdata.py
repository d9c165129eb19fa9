"""A ledger view over the star-schema test tables."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import TO_GBP, fixed_rate

LEDGER = (
    "id string, timestamp timestamp, asset string, transaction_type string, amount double, fiat_value_at_trigger double, fee_fiat double, fiat_currency string, "
    "source string, import_id string, transfer_direction string, transfer_pair_id string, counterparty_address string, counter_asset string, counter_amount double, "
    "trade_group_id string, on_chain_tx_id string, token_mint string, instrument_kind string, instrument string, venue_order_type string, realized_pnl double, "
    "event_subtype string, parent_asset string, normalization_note string, seq bigint"
)
CURRENCIES = ("GBP", "USD", "EUR", "USDT", "JPY", None)


def conform(df: DataFrame) -> DataFrame:
    """The ledger's columns in order, missing ones null."""
    want = [x.strip().split(" ") for x in LEDGER.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in want])


def ledger_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as ledger legs: parts are assets, suppliers venues, orders trade groups; returned lines are disposals.

    Of the order numbers mod 20, 0 and 1 are income, 2 fees, 3 transfers.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)"), day)
    m, out = F.pmod("l_orderkey", F.lit(20)), F.col("l_returnflag") == "R"
    kind = (
        F.when(m == 3, "TRANSFER").when(out & (m == 2), "FEE").when(out, "SELL").when(m == 0, "STAKING").when(m == 1, "AIRDROP").otherwise("BUY")
    )
    currency = F.array(*[F.lit(c) for c in CURRENCIES])
    return conform(
        li.select(
            F.md5(key).alias("id"), F.col("l_shipdate").alias("timestamp"), F.concat(F.lit("P"), "l_partkey").alias("asset"), kind.alias("transaction_type"),
            F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("fiat_value_at_trigger"), F.round(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(4,2)"), 2).cast("double").alias("fee_fiat"),
            F.element_at(currency, (F.pmod("l_suppkey", F.lit(len(CURRENCIES))) + 1).cast("int")).alias("fiat_currency"),
            F.concat(F.lit("V"), F.pmod("l_suppkey", F.lit(10))).alias("source"), F.concat(F.lit("I"), F.pmod("l_suppkey", F.lit(25))).alias("import_id"),
            F.when(m == 3, F.when(out, "OUT").otherwise("IN")).alias("transfer_direction"), F.col("l_orderkey").cast("string").alias("trade_group_id"),
            F.when(F.pmod("l_suppkey", F.lit(7)) == 0, "perp").alias("instrument_kind"), F.when((F.pmod("l_suppkey", F.lit(7)) == 0) & out, (F.col("l_discount") - 0.05) * 1000).alias("realized_pnl"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )
    )


def rates_from_tpch(spark: SparkSession, sf_dir: str, to_ccy: str) -> DataFrame:
    """(day, from_ccy, rate) on the days of lineitem whose number in the month isn't a multiple of 3: the fallback, moved by the day of the year."""
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).where(F.dayofmonth("day") % 3 != 0).distinct()
    factor = (F.lit(90) + F.dayofyear("day") % 20).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(2,2)")
    x = days.withColumn("from_ccy", F.explode(F.array(*[F.lit(c) for c in TO_GBP])))
    return x.where(F.col("from_ccy") != to_ccy).select("day", "from_ccy", F.round(fixed_rate(F.col("from_ccy"), to_ccy) * factor, 8).cast("decimal(12,8)").alias("rate"))


def prices_from_tpch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily prices (asset, day, price), the highest of each part on even days of the month, and spot prices (asset, price)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.dayofmonth("l_shipdate") % 2 == 0)
    daily = li.groupBy(F.concat(F.lit("P"), "l_partkey").alias("asset"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("price"))
    return daily, spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("asset"), F.col("p_retailprice").alias("price"))


def _rate_sql(to_ccy: str) -> str:
    fixed = {c: (Decimal(str(r)) / Decimal(str(TO_GBP[to_ccy]))).quantize(Decimal("1e-8"), ROUND_HALF_UP) for c, r in TO_GBP.items()}
    case = " ".join(f"WHEN '{c}' THEN {r}::decimal(12,8)" for c, r in fixed.items() if c in ("GBP", "EUR", "JPY"))
    rate = f"CASE from_ccy {case} ELSE {fixed['USD']}::decimal(12,8) END"
    return f"CASE WHEN from_ccy = '{to_ccy}' OR day(ts) % 3 = 0 THEN {rate} ELSE round({rate} * ((90 + dayofyear(ts) % 20)::decimal(4,0) * 0.01::decimal(2,2)), 8)::decimal(12,8) END"


#: The same view in SQL, with the rates to GBP and USD of each row.
LEDGER_SQL = f"""
ledger AS (SELECT *, {_rate_sql("GBP")} AS gbp, {_rate_sql("USD")} AS usd FROM (SELECT *, timestamp AS ts, CASE WHEN ccy IN ('GBP', 'EUR', 'JPY') THEN ccy ELSE 'USD' END AS from_ccy FROM (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::decimal(18,2), l_extendedprice::decimal(18,2), strftime(l_shipdate, '%Y-%m-%d'))) AS id,
    l_shipdate AS timestamp, 'P' || l_partkey AS asset,
    CASE WHEN l_orderkey % 20 = 3 THEN 'TRANSFER' WHEN l_returnflag = 'R' AND l_orderkey % 20 = 2 THEN 'FEE' WHEN l_returnflag = 'R' THEN 'SELL' WHEN l_orderkey % 20 = 0 THEN 'STAKING' WHEN l_orderkey % 20 = 1 THEN 'AIRDROP' ELSE 'BUY' END AS transaction_type,
    l_quantity AS amount, l_extendedprice AS fiat, round(l_extendedprice::decimal(18,2) * l_tax::decimal(4,2), 2)::double AS fee,
    CASE l_suppkey % 6 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'USDT' WHEN 4 THEN 'JPY' END AS ccy,
    'V' || (l_suppkey % 10) AS source, 'I' || (l_suppkey % 25) AS import_id,
    CASE WHEN l_orderkey % 20 = 3 THEN CASE WHEN l_returnflag = 'R' THEN 'OUT' ELSE 'IN' END END AS dir, l_orderkey::varchar AS gid,
    CASE WHEN l_suppkey % 7 = 0 THEN 'perp' END AS kind, CASE WHEN l_suppkey % 7 = 0 AND l_returnflag = 'R' THEN (l_discount - 0.05) * 1000 END AS pnl,
    l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem)))"""
