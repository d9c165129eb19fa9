"""Further ledger queries, on values, copies and views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import classifiers as C
from .operators import duplicates as D
from .operators import enrichment as E
from .operators import ledger_ops as L
from .operators import liquidity as Q
from .operators import receipts as R
from .operators import views as W
from .plans import us_lots as US
from .sources.testdata import LEDGER_SQL, ledger_from_tpch, prices_from_tpch, rates_from_tpch


def _mixed(x: DataFrame) -> DataFrame:
    """Half of the transfers in booked as rewards, and every third row without a value."""
    turn = (F.col("transfer_direction") == "IN") & (F.pmod("seq", F.lit(2)) == 0)
    turn = F.coalesce(turn, F.lit(False))
    return x.withColumns({
        "transaction_type": F.when(turn, "STAKING").otherwise(F.col("transaction_type")), "transfer_direction": F.when(turn, F.lit(None)).otherwise(F.col("transfer_direction")),
        "fiat_value_at_trigger": F.when(F.pmod("seq", F.lit(3)) == 0, 0.0).otherwise(F.col("fiat_value_at_trigger")),
    })


def _fewer(x: DataFrame) -> DataFrame:
    """The view with forty assets and amounts of 1 to 5, so that legs of one asset are near each other."""
    return x.withColumns({"asset": F.concat(F.lit("P"), F.pmod(F.substring("asset", 2, 9).cast("int"), F.lit(40))), "amount": F.pmod("amount", F.lit(5)) + 1})


def _on(f):
    return lambda spark, sf_dir: f(ledger_from_tpch(spark, sf_dir))


def _memes(prices: DataFrame) -> DataFrame:
    """Every 23rd part as a coin of 1e-12 of its price."""
    return prices.withColumn("price", F.col("price") * F.when(F.substring("asset", 2, 9).cast("int") % 23 == 0, 1e-12).otherwise(1.0))


def _values(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = _mixed(ledger_from_tpch(spark, sf_dir))
        x = x.withColumn("amount", F.col("amount") * F.when(F.substring("asset", 2, 9).cast("int") % 23 == 0, 1e13).otherwise(1.0))
        return f(x, *map(_memes, prices_from_tpch(spark, sf_dir))).select("id", F.col("fiat_value_at_trigger").alias("value"), "fiat_currency")

    return run


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, spot = prices_from_tpch(spark, sf_dir)
    number = F.substring("asset", 2, 9).cast("int")
    last = daily.where(number % 3 == 0).groupBy("asset").agg(F.max("price").alias("price"))
    manual = spot.where(number % 7 == 0).withColumn("price", F.lit(0.0))
    floor = spot.where(number % 11 != 0).select("asset", (F.col("price") * 2).alias("price")).where(number % 2 == 0)
    return E.resolve_prices(ledger_from_tpch(spark, sf_dir), ("manual", manual), ("daily", last), ("spot", spot.where(number % 5 != 0)), floor=floor.where(number % 7 != 0))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.where("p_partkey % 2 = 0").select(F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("mint"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("P"), "p_partkey")).alias("symbol"))


def _chain(x: DataFrame) -> DataFrame:
    """The view as one chain's rows with mints; some are trades without value and some name a counter asset."""
    return _mixed(x).withColumns({"source": F.when(F.col("source") != "V9", "solana").otherwise(F.col("source")), "token_mint": F.md5(F.substring("asset", 2, 9).cast("binary")), "counter_asset": F.when(F.pmod("seq", F.lit(5)) == 0, "USDC"), "trade_group_id": F.when(F.pmod("seq", F.lit(7)) > 2, F.col("trade_group_id")), "amount": F.col("amount") * 400})


def _spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.chain_spam(_chain(ledger_from_tpch(spark, sf_dir)), _listed(spark, sf_dir)).select("id", "is_spam")


def _ids(x: DataFrame) -> DataFrame:
    """Trade groups and ids in the forms that show an on-chain id, or not."""
    h = F.md5(F.col("trade_group_id").cast("binary"))
    kind = F.pmod("seq", F.lit(6))
    return x.withColumns({
        "source": F.when(kind == 2, "bitcoin").when(kind == 3, "celestia").when(kind == 4, "solana").otherwise(F.col("source")), "trade_group_id": F.when(kind == 1, F.concat(F.lit("0x"), h, h)).when(kind.isin(2, 3), h).otherwise(F.col("trade_group_id")),
        "id": F.when(kind == 5, F.concat(F.lit("cryptocom-"), h, h)).when(kind == 4, F.concat(F.lit("sol-"), h)).otherwise(F.col("id")), "on_chain_tx_id": F.when(kind == 4, h),
    })


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ordered_overlaps(L.import_overlaps(ledger_from_tpch(spark, sf_dir)))


def _earlier(x: DataFrame) -> DataFrame:
    gaps = x.groupBy("asset").agg(F.to_date(F.min("timestamp")).alias("a"), F.to_date(F.max("timestamp")).alias("b")).select("asset", F.explode(F.array("a", "b", F.lit("2000-01-01").cast("date"))).alias("before"))
    ended = x.where(F.col("timestamp") < F.when(F.col("import_id") < "I2", F.lit("1998-06-01")).otherwise(F.lit("1997-01-01")).cast("timestamp"))
    return W.earlier_import(ended, gaps)


def _realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = US.matches(ledger_from_tpch(spark, sf_dir), "FIFO", "USD", rates_from_tpch(spark, sf_dir, "USD"))
    return W.by_gain(US.realized_by_asset(m)).limit(25).select("asset", "realized_pnl")


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = US.lot_events(ledger_from_tpch(spark, sf_dir), "USD", rates_from_tpch(spark, sf_dir, "USD"))
    return W.holdings(US.positions(US.fifo_open_lots(e), prices_from_tpch(spark, sf_dir)[1]))


def _labels(x: DataFrame) -> DataFrame:
    """Asset names as uploads spell them."""
    k = F.pmod("seq", F.lit(8))
    name = (
        F.when(k == 0, F.concat(F.lit(" "), F.lower("asset"), F.lit(" "))).when(k == 1, F.md5(F.col("asset").cast("binary"))).when(k == 2, "usd\u20ae").when(k == 3, " usdc ").when(k == 4, F.concat(F.lit("claim at "), "asset", F.lit(".com")))
        .when(k == 5, "  ").when(k == 6, F.concat(F.lit("www."), "asset")).otherwise(F.col("asset"))
    )
    return x.select("id", S.normalise_asset(name).alias("asset"), S.is_stable(name).alias("stable"), L.is_spam(name).alias("spam"))


def _income(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.income_rows(ledger_from_tpch(spark, sf_dir), rates_from_tpch(spark, sf_dir, "GBP"))
    return rows.select("id", "asset", "source", "transaction_type", "day", "tax_year", "amount", S.money(F.col("income_c")).alias("income"))


def _by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.income_by_asset(ledger_from_tpch(spark, sf_dir), rates_from_tpch(spark, sf_dir, "GBP"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.order_groups(L.perp_legs(ledger_from_tpch(spark, sf_dir), "USD", rates_from_tpch(spark, sf_dir, "USD")))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.displayed(prices_from_tpch(spark, sf_dir)[1].withColumn("unit", F.col("price")), ["price"], ["unit"], 0.7913)


def _burns(x: DataFrame) -> DataFrame:
    """Pools of the view with fifty kinds of shares; every seventh group that takes assets out burns two shares."""
    y = C.liquidity_for_tax(x)
    n = F.col("trade_group_id").cast("bigint")
    kind = F.concat(F.lit("LP:"), F.pmod(n, F.lit(50)))
    made = F.startswith("asset", F.lit("LP:"))
    y = y.withColumns({"amount": F.when(made, 1.0 + F.pmod(n, F.lit(3))).otherwise(F.col("amount")), "asset": F.when(made, kind).otherwise(F.col("asset"))})
    out = y.where((F.col("event_subtype") == "lp_remove") & (n % 7 == 0)).groupBy("trade_group_id", "event_subtype").agg(F.min("timestamp").alias("timestamp"))
    out = out.select(F.concat(F.lit("burn-"), "trade_group_id").alias("id"), "timestamp", kind.alias("asset"), F.lit("SELL").alias("transaction_type"), F.lit(2.0).alias("amount"), "event_subtype", "trade_group_id")
    z = Q.missing_burns(y.unionByName(out, allowMissingColumns=True))
    return z.select("id", "asset", "timestamp", "amount", F.col("fiat_value_at_trigger").alias("value"), F.col("normalization_note").alias("note"))


def _receipts(x: DataFrame) -> DataFrame:
    """The view on one chain with ids in which two of three rows agree."""
    k = F.pmod("seq", F.lit(3))
    return _fewer(x).withColumns({"source": F.lit("solana"), "on_chain_tx_id": F.when(k > 0, k.cast("string"))})


VENUES = ("V1", "V2", "V3", "V4", "V5")
ODD = tuple(f"P{i}" for i in range(1, 2000, 2))
EVEN = tuple(f"P{i}" for i in range(0, 40, 2))
DAYS = 3 * 86400
QUERIES = {
    "fee_values": _values(lambda x, d, s: E.fee_values(x, d, s)),
    "income_values": _values(lambda x, d, s: E.income_values(x, d, s.where("price < 1500"))),
    "wallet_values": _values(lambda x, d, s: E.wallet_values(x, d, s, "1997-01-01", ("V1", "V2", "V3"), ("V2",))),
    "staking_values": _values(lambda x, d, s: E.staking_values(x, d, s, "1995-06-01", VENUES)),
    "leg_values": _values(lambda x, d, s: E.leg_values(x, d)),
    "resolved_prices": _priced,
    "unresolved_assets": lambda s, d: E.unresolved(ledger_from_tpch(s, d), _priced(s, d)),
    "displayed_prices": _shown,
    "hidden_assets": _on(lambda x: W.visible(x, x.sparkSession.createDataFrame([(f" p{i}",) for i in range(0, 500, 3)], "asset string")).select("id", "asset")),
    "demo_mode": _on(lambda x: W.without_demo(x, x.where(F.pmod("seq", F.lit(4)) == 0)).select("id", "seq")),
    "import_rows": _on(lambda x: W.of_import(x.withColumn("import_id", F.when(F.pmod("seq", F.lit(2)) == 0, F.col("import_id"))), "legacy:v3").unionByName(W.of_import(x, "I7")).select("id", "seq")),
    "appended_batch": _on(lambda x: W.appended(x.where(F.pmod("seq", F.lit(4)) < 3), x.where(F.pmod("seq", F.lit(4)) > 1), x.where(F.pmod("seq", F.lit(4)) == 0)).select("id", "seq")),
    "spam_rows": _spam,
    "liquidity_notes": _on(lambda x: W.liquidity_notes(x.withColumns({"event_subtype": F.when(F.pmod("seq", F.lit(3)) == 0, "lp_remove"), "normalization_note": F.when(F.pmod("seq", F.lit(5)) == 0, "please Verify").when(F.pmod("seq", F.lit(5)) == 1, "burn").when(F.pmod("seq", F.lit(5)) == 2, "")}))),
    "ledger_counts": _on(W.counts),
    "ledger_periods": _on(W.periods),
    "realized_by_gain": _realized,
    "upload_preview": lambda s, d: W.preview(s.read.parquet(f"{d}/orders.parquet").orderBy("o_orderkey").select("o_orderkey", F.concat_ws("-", "o_orderkey", F.repeat(F.lit("x"), 60)).alias("long"), *[F.lit(i).alias(f"c{i}") for i in range(9)])),
    "newest_rows": _on(lambda x: W.newest(x).select("source", "id", "timestamp")),
    "ordered_overlaps": _overlaps,
    "earlier_imports": _on(_earlier),
    "order_groups": _orders,
    "holdings": _holdings,
    "acquisitions": _on(lambda x: W.acquisitions(x, "P7").select("id", "transaction_type", "amount")),
    "on_chain_ids": _on(lambda x: W.with_on_chain_ids(_ids(x)).select("seq", "on_chain_tx_id")),
    "repaired_groups": _on(lambda x: W.repaired_groups(_ids(x)).select("seq", "trade_group_id")),
    "tagged_rows": _on(lambda x: W.tagged(x.withColumn("source", F.when(F.pmod("seq", F.lit(2)) == 0, F.col("source"))), "imp-1", "upload").select("id", "import_id", "source")),
    "liquid_sale_copies": _on(lambda x: D.liquid_sales(_fewer(x).withColumns({"source": F.lit("solana"), "on_chain_tx_id": F.when(F.pmod("seq", F.lit(3)) > 0, F.md5(F.pmod("seq", F.lit(50)).cast("string").cast("binary"))), "trade_group_id": F.when(F.pmod("seq", F.lit(4)) > 0, F.md5(F.concat(F.lit("g"), F.pmod(F.col("seq"), F.lit(70)).cast("string")).cast("binary")))}), ODD, seconds=DAYS)),
    "swap_leg_copies": _on(lambda x: D.swap_legs(_fewer(x).withColumns({"source": F.lit("solana"), "token_mint": F.when(F.pmod("seq", F.lit(3)) > 0, F.pmod("seq", F.lit(3)).cast("string"))}), seconds=DAYS, tolerance=0.03)),
    "deposit_reward_copies": _on(lambda x: D.deposit_rewards(_fewer(_mixed(x)), VENUES, DAYS)),
    "collapsed_exchange": _on(lambda x: D.collapse_exchange_noise(_fewer(_mixed(x)), VENUES, 24 * 9).select("id", "transaction_type")),
    "without_staking": _on(lambda x: D.without_staking(_fewer(_mixed(x)), VENUES, 24 * 9).select("id", "transaction_type")),
    "asset_rules": _on(_labels),
    "income_rows": _income,
    "income_by_asset": _by_asset,
    "inferred_burns": _on(_burns),
    "sale_inflows": _on(lambda x: R.sale_inflows(_receipts(x), ODD, seconds=DAYS)),
    "unstake_receipts": _on(lambda x: R.unstake_receipts(_receipts(x), ("P1", "P3", "P5"), ("P0", "P2"), seconds=DAYS)),
    "native_legs": _on(lambda x: R.native_legs(_receipts(x).withColumn("fiat_value_at_trigger", F.col("fiat_value_at_trigger") / 1000), ODD, EVEN).where("transaction_type in ('FEE', 'BUY')").select("id", "transaction_type", "counter_asset")),
}

_L = "WITH" + LEDGER_SQL
_M = _L + """, mixed AS (SELECT * REPLACE (CASE WHEN dir = 'IN' AND seq % 2 = 0 THEN 'STAKING' ELSE transaction_type END AS transaction_type, CASE WHEN dir = 'IN' AND seq % 2 = 0 THEN NULL ELSE dir END AS dir, CASE WHEN seq % 3 = 0 THEN 0 ELSE fiat END AS fiat) FROM ledger)"""
_FEW = LEDGER_SQL.replace("ledger AS (", "all_ AS (", 1) + ", ledger AS (SELECT * REPLACE ('P' || (substr(asset, 2)::int % 40) AS asset, amount % 5 + 1 AS amount) FROM all_)"
_F = "WITH" + _FEW
_FM = _M.replace(LEDGER_SQL, _FEW)
_P = _M + """,
  px AS (SELECT 'P' || l_partkey AS asset, l_shipdate::date AS day, max(l_extendedprice)::decimal(18,6) AS price FROM lineitem WHERE day(l_shipdate) % 2 = 0 GROUP BY 1, 2),
  sp AS (SELECT 'P' || p_partkey AS asset, p_retailprice::decimal(18,6) AS price FROM part),
  w AS (SELECT m.*, px.price AS daily, sp.price AS spot FROM mixed m LEFT JOIN px ON px.asset = m.asset AND px.day = m.timestamp::date LEFT JOIN sp ON sp.asset = m.asset)"""


_PV = _M + """,
  px AS (SELECT 'P' || l_partkey AS asset, l_shipdate::date AS day, max(l_extendedprice * CASE WHEN l_partkey % 23 = 0 THEN 1e-12::double ELSE 1.0::double END)::varchar::decimal(38,18) AS price FROM lineitem WHERE day(l_shipdate) % 2 = 0 GROUP BY 1, 2),
  sp AS (SELECT 'P' || p_partkey AS asset, (p_retailprice * CASE WHEN p_partkey % 23 = 0 THEN 1e-12::double ELSE 1.0::double END)::varchar::decimal(38,18) AS price FROM part),
  w AS (SELECT m.* REPLACE (m.amount * CASE WHEN substr(m.asset, 2)::int % 23 = 0 THEN 1e13::double ELSE 1.0::double END AS amount), px.price AS daily, sp.price AS spot FROM mixed m LEFT JOIN px ON px.asset = m.asset AND px.day = m.timestamp::date LEFT JOIN sp ON sp.asset = m.asset)"""


def _value_sql(which: str, price: str, least: float, currency: str = "'USD'") -> str:
    # Whole cents from a whole quantity and a price of 18 places, half up.
    v = f"(((amount::hugeint * replace(({price})::varchar, '.', '')::hugeint + 5000000000000000) // 10000000000000000) / 100.0::double)"
    ok = f"({which}) AND coalesce({v} >= {least}::double, false)"
    return _PV + f" SELECT id, CASE WHEN {ok} THEN {v}::double ELSE fiat END AS value, CASE WHEN {ok} THEN {currency} ELSE ccy END AS fiat_currency FROM w"


_NEAR = "abs(epoch(a.timestamp) - epoch(b.timestamp)) <= 259200 AND abs(a.amount - b.amount) <= greatest(a.amount, b.amount) * {}::double"
_IDS = _L + """, k AS (SELECT seq, id, seq % 6 AS k, gid, md5(gid) AS h, CASE seq % 6 WHEN 2 THEN 'bitcoin' WHEN 3 THEN 'celestia' WHEN 4 THEN 'solana' ELSE source END AS source FROM ledger)"""
_YEAR = "(year(timestamp) - CASE WHEN strftime(timestamp, '%m%d') < '0406' THEN 1 ELSE 0 END) || '/' || lpad(((year(timestamp) - CASE WHEN strftime(timestamp, '%m%d') < '0406' THEN 1 ELSE 0 END + 1) % 100)::varchar, 2, '0')"
_PRICED = _P + """, n AS (SELECT DISTINCT asset, substr(asset, 2)::int AS n FROM ledger),
  d AS (SELECT asset, max(price) AS price FROM px GROUP BY 1),
  r AS (SELECT n.asset, CASE WHEN n % 2 = 0 AND n % 11 <> 0 AND n % 7 <> 0 THEN sp.price * 2 ELSE 0 END AS low, CASE WHEN n % 7 = 0 AND sp.price IS NOT NULL THEN 0::decimal(18,6) END AS manual, CASE WHEN n % 3 = 0 THEN d.price END AS daily, CASE WHEN n % 5 <> 0 THEN sp.price END AS spot FROM n LEFT JOIN d USING (asset) LEFT JOIN sp USING (asset)),
  q AS (SELECT asset, CASE WHEN manual >= low THEN manual END AS manual, CASE WHEN daily >= low THEN daily END AS daily, CASE WHEN spot >= low THEN spot END AS spot FROM r)"""
_STAKES = """, keep AS (SELECT gid FROM mixed GROUP BY 1 HAVING bool_or(transaction_type = 'STAKING') AND bool_or(transaction_type = 'TRANSFER' AND dir = 'IN')),
  ex AS (SELECT * FROM mixed WHERE source IN ('V1', 'V2', 'V3', 'V4', 'V5'))"""
_ECHO = "SELECT o.id FROM ex o JOIN {} s ON o.transaction_type = 'TRANSFER' AND o.dir = 'OUT' AND s.transaction_type = 'STAKING' AND o.asset = s.asset AND o.source = s.source AND epoch(o.timestamp) - epoch(s.timestamp) BETWEEN 0 AND 777600 AND abs(o.amount - s.amount) <= greatest(o.amount, s.amount) * 0.02::double"
_AGREE = "(o.seq % 3 = 0 OR i.seq % 3 = 0 OR o.seq % 3 = i.seq % 3)"
SQL = {
    "fee_values": _value_sql("transaction_type = 'FEE' AND fiat < 0.01", "coalesce(daily, spot)", 0.01, "coalesce(ccy, 'USD')"),
    "income_values": _value_sql("transaction_type IN ('AIRDROP', 'STAKING') AND fiat <= 0.5", "coalesce(daily, CASE WHEN spot < 1500 THEN spot END)", 0.51),
    "wallet_values": _value_sql("source IN ('V1', 'V2', 'V3') AND (fiat <= 0 OR source = 'V2') AND NOT (coalesce(dir = 'IN', false) AND gid IN (SELECT gid FROM mixed GROUP BY 1 HAVING bool_or(transaction_type = 'STAKING') AND bool_or(transaction_type = 'TRANSFER' AND dir = 'IN')))", "coalesce(daily, CASE WHEN timestamp >= '1997-01-01' THEN spot END)", 0.01),
    "staking_values": _value_sql("transaction_type = 'STAKING' AND fiat <= 0 AND source IN ('V1', 'V2', 'V3', 'V4', 'V5')", "coalesce(daily, CASE WHEN timestamp >= '1995-06-01' THEN spot END)", 0.01),
    "leg_values": _value_sql("fiat <= 0", "daily", 0.01),
    "resolved_prices": _PRICED + " SELECT asset, coalesce(manual, daily, spot)::double AS price, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN daily IS NOT NULL THEN 'daily' WHEN spot IS NOT NULL THEN 'spot' END AS price_source FROM q",
    "unresolved_assets": _PRICED + " SELECT asset FROM q WHERE coalesce(manual, daily, spot) IS NULL",
    "displayed_prices": "SELECT 'P' || p_partkey AS asset, round(p_retailprice::decimal(24,8) * 0.7913::decimal(12,8), 2)::double AS price, round(p_retailprice::decimal(24,8) * 0.7913::decimal(12,8), 4)::double AS unit FROM part",
    "hidden_assets": _L + " SELECT id, asset FROM ledger WHERE NOT (substr(asset, 2)::int < 500 AND substr(asset, 2)::int % 3 = 0)",
    "demo_mode": _L + " SELECT id, seq FROM ledger WHERE seq % 4 <> 0",
    "import_rows": _L + " SELECT id, seq FROM ledger WHERE source = 'V3' AND seq % 2 = 1 UNION ALL SELECT id, seq FROM ledger WHERE import_id = 'I7'",
    "appended_batch": _L + ", r AS (SELECT * FROM ledger WHERE seq % 4 IN (1, 2)) SELECT id, seq FROM r UNION ALL SELECT id, seq FROM ledger l WHERE seq % 4 > 1 AND NOT EXISTS (FROM r WHERE r.id = l.id) AND NOT EXISTS (FROM r WHERE r.timestamp = l.timestamp AND r.asset = l.asset AND r.transaction_type = l.transaction_type AND r.amount = l.amount AND r.source = l.source)",
    "spam_rows": _M
    + """, x AS (SELECT id, transaction_type AS t, fiat, source, amount * 400 AS a, substr(asset, 2)::int % 2 = 0 AS listed, seq % 5 = 0 AS counter, seq % 7 > 2 AS grouped FROM mixed)
  SELECT id, source <> 'V9' AND CASE WHEN NOT listed THEN t = 'TRANSFER' OR NOT (t IN ('BUY', 'SELL') AND (fiat >= 0.5 OR counter)) ELSE t IN ('BUY', 'SELL') AND fiat <= 0.5 AND NOT counter AND (grouped OR a > 10000) END AS is_spam FROM x""",
    "liquidity_notes": _L + " SELECT id, asset, CASE seq % 5 WHEN 0 THEN 'please Verify' ELSE 'burn' END AS note, seq % 5 = 0 AS ambiguous FROM ledger WHERE seq % 3 = 0 AND seq % 5 < 2",
    "ledger_counts": _L + " SELECT 'source' AS facet, source AS value, count(*) AS n FROM ledger GROUP BY 2 UNION ALL SELECT 'type', transaction_type, count(*) FROM ledger GROUP BY 2 UNION ALL SELECT 'asset', asset, count(*) FROM ledger GROUP BY 2",
    "ledger_periods": _L + f" SELECT DISTINCT 'calendar' AS kind, year(timestamp)::varchar AS period FROM ledger UNION ALL SELECT DISTINCT 'uk', {_YEAR} FROM ledger",
    "upload_preview": "SELECT o_orderkey::varchar AS o_orderkey, substr(o_orderkey || '-' || repeat('x', 60), 1, 48) AS long, " + ", ".join(f"'{i}' AS c{i}" for i in range(6)) + " FROM orders ORDER BY orders.o_orderkey LIMIT 3",
    "newest_rows": _L + " SELECT source, id, timestamp FROM ledger QUALIFY row_number() OVER (PARTITION BY source ORDER BY timestamp DESC, seq DESC, id) <= 3",
    "earlier_imports": _L
    + """, g AS (SELECT DISTINCT asset, unnest([min(timestamp)::date, max(timestamp)::date, DATE '2000-01-01']) AS before FROM ledger GROUP BY asset),
  e AS (SELECT * FROM ledger WHERE timestamp < CASE WHEN import_id < 'I2' THEN TIMESTAMP '1998-06-01' ELSE TIMESTAMP '1997-01-01' END), i AS (SELECT import_id, max(timestamp)::date AS end_day FROM e GROUP BY 1), h AS (SELECT DISTINCT asset, import_id, end_day FROM e JOIN i USING (import_id))
  SELECT g.asset, g.before, arg_max(h.import_id, (end_day, h.import_id)) AS import_id, max(end_day) AS end_day FROM g LEFT JOIN h ON h.asset = g.asset AND h.end_day < g.before GROUP BY 1, 2""",
    "order_groups": _L
    + """ SELECT source, gid AS trade_group_id, count(*) AS n_fills, sum(amount) AS quantity, sum((round(fiat::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS value, sum((round(fee::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS fee,
  sum((round(pnl::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS pnl, min(timestamp) AS first_at FROM ledger WHERE kind = 'perp' GROUP BY 1, 2""",
    "acquisitions": _L + " SELECT id, transaction_type, amount FROM ledger WHERE asset = 'P7' AND (transaction_type IN ('BUY', 'AIRDROP', 'STAKING') OR dir = 'IN')",
    "on_chain_ids": _IDS + " SELECT seq, CASE k WHEN 1 THEN '0x' || h || h WHEN 2 THEN h WHEN 3 THEN h WHEN 4 THEN h WHEN 5 THEN h || h END AS on_chain_tx_id FROM k",
    "repaired_groups": _IDS + " SELECT seq, CASE k WHEN 1 THEN '0x' || h || h WHEN 0 THEN gid WHEN 5 THEN gid ELSE h END AS trade_group_id FROM k",
    "tagged_rows": _L + " SELECT id, 'imp-1' AS import_id, CASE WHEN seq % 2 = 0 THEN source ELSE 'upload' END AS source FROM ledger",
    "liquid_sale_copies": _F + f""", s AS (SELECT *, CASE WHEN seq % 3 > 0 THEN left(md5((seq % 50)::varchar), 16) WHEN seq % 4 > 0 THEN left(md5('g' || (seq % 70)), 16) END AS sig, CASE WHEN seq % 4 > 0 THEN seq % 70 END AS grp FROM ledger)
  SELECT DISTINCT a.id FROM s a JOIN s b ON a.asset = b.asset AND a.dir = 'OUT' AND b.transaction_type = 'SELL' AND substr(a.asset, 2)::int % 2 = 1 AND abs(a.amount - b.amount) <= greatest(a.amount, b.amount) * 0.02::double AND (abs(epoch(a.timestamp) - epoch(b.timestamp)) <= 259200 OR a.sig = b.sig OR a.grp = b.grp)""",
    "swap_leg_copies": _F + f" SELECT DISTINCT a.id FROM ledger a JOIN ledger b ON a.asset = b.asset AND a.dir = 'IN' AND b.transaction_type = 'BUY' AND (a.seq % 3 = 0 OR b.seq % 3 = 0 OR a.seq % 3 = b.seq % 3) AND {_NEAR.format(0.03)}",
    "deposit_reward_copies": _FM + f" SELECT DISTINCT a.id FROM mixed a JOIN mixed b ON a.asset = b.asset AND a.source = b.source AND a.source IN ('V1', 'V2', 'V3', 'V4', 'V5') AND a.transaction_type = 'STAKING' AND b.dir = 'IN' AND {_NEAR.format(0.02)}",
    "collapsed_exchange": _FM + _STAKES + f", echo AS ({_ECHO.format('ex')}), l AS (SELECT * FROM mixed WHERE id NOT IN (FROM echo)), gone AS (SELECT a.id FROM l a JOIN l b ON a.asset = b.asset AND a.source = b.source AND a.source IN ('V1', 'V2', 'V3', 'V4', 'V5') AND a.transaction_type = 'STAKING' AND b.dir = 'IN' AND a.timestamp = b.timestamp AND abs(a.amount - b.amount) <= greatest(a.amount, b.amount) * 0.02::double) SELECT id, transaction_type FROM l WHERE id NOT IN (FROM gone)",
    "without_staking": _FM + _STAKES + f", drop_ AS (SELECT * FROM mixed WHERE transaction_type = 'STAKING' AND gid NOT IN (FROM keep)), echo AS ({_ECHO.format('drop_')}) SELECT id, transaction_type FROM mixed WHERE id NOT IN (SELECT id FROM drop_) AND id NOT IN (FROM echo)",
    "asset_rules": _L
    + """, n AS (SELECT id, seq % 8 AS k, CASE seq % 8 WHEN 0 THEN asset WHEN 1 THEN md5(asset) WHEN 2 THEN 'USD' || chr(8366) WHEN 3 THEN 'USDC' WHEN 4 THEN 'CLAIM AT ' || asset || '.COM' WHEN 5 THEN NULL WHEN 6 THEN 'WWW.' || asset ELSE asset END AS asset FROM ledger)
  SELECT id, asset, k IN (2, 3) AS stable, k IN (4, 6) AS spam FROM n""",
    "income_rows": _L + f" SELECT id, asset, source, transaction_type, timestamp::date AS day, {_YEAR} AS tax_year, amount, (round(fiat::decimal(24,6) * gbp, 2) * 100)::hugeint / 100.0::double AS income FROM ledger WHERE transaction_type IN ('AIRDROP', 'STAKING')",
    "income_by_asset": _L + f" SELECT asset, count(*) AS n_rows, sum(amount) AS quantity, sum((round(fiat::decimal(24,6) * gbp, 2) * 100)::hugeint) FILTER (transaction_type = 'STAKING') / 100.0::double AS staking, sum((round(fiat::decimal(24,6) * gbp, 2) * 100)::hugeint) FILTER (transaction_type = 'AIRDROP') / 100.0::double AS airdrops FROM ledger WHERE transaction_type IN ('AIRDROP', 'STAKING') GROUP BY 1",
    "inferred_burns": _L
    + """, x AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN transaction_type = 'TRANSFER' THEN dir WHEN transaction_type = 'SELL' THEN 'OUT' WHEN transaction_type = 'BUY' THEN 'IN' END END AS way FROM ledger),
  g AS (SELECT gid, gid::bigint AS n, CASE WHEN count(*) FILTER (way = 'IN') = 0 AND count(*) FILTER (way = 'OUT') >= 2 THEN 'lp_add' WHEN count(*) FILTER (way = 'OUT') = 0 AND count(*) FILTER (way = 'IN') >= 2 THEN 'lp_remove' END AS ev,
    round(sum(fiat::decimal(18,2)) FILTER (way IS NOT NULL), 2)::double AS total, min(timestamp) FILTER (way IS NOT NULL) AS first_at FROM x GROUP BY 1),
  sold AS (SELECT 'LP:' || (n % 50) AS asset, 2 * count(*) AS sold FROM g WHERE ev = 'lp_remove' AND n % 7 = 0 GROUP BY 1),
  lots AS (SELECT 'lp-acquire-' || gid AS id, 'LP:' || (n % 50) AS asset, first_at, 1 + n % 3 AS amount FROM g WHERE ev = 'lp_add'),
  held AS (SELECT l.*, least(amount, greatest(0, sum(amount) OVER (PARTITION BY l.asset ORDER BY first_at, id) - coalesce(sold, 0))) AS rest FROM lots l LEFT JOIN sold ON sold.asset = l.asset),
  ranked AS (SELECT *, row_number() OVER (ORDER BY first_at, id) AS k, count(*) OVER () AS n FROM held WHERE rest > 0),
  ends AS (SELECT asset, max(k) AS k FROM ranked GROUP BY 1),
  r AS (SELECT gid, first_at, total, row_number() OVER (ORDER BY first_at, gid) AS k FROM g WHERE ev = 'lp_remove' AND n % 7 <> 0)
  SELECT 'lp-dispose-' || r.gid AS id, l.asset, r.first_at AS timestamp, l.rest::double AS amount, r.total AS value, 'The burn of a pool share is missing: closes the oldest open one, ' || l.asset || '.'
    || CASE WHEN l.n - l.k >= 1 THEN ' ' || (l.n - l.k + 1) || ' shares of ' || (SELECT count(*) FROM ends WHERE ends.k >= l.k) || ' assets were open, please verify.' ELSE '' END AS note
  FROM r JOIN ranked l USING (k)""",
    "native_legs": _F
    + """, x AS (SELECT *, fiat / 1000 AS v, substr(asset, 2)::int % 2 = 1 AS receipt FROM ledger),
  g AS (SELECT gid, max(struct_pack(v := v, coin := asset)) FILTER (transaction_type = 'SELL' AND receipt) AS top, bool_or(transaction_type = 'BUY' AND NOT receipt) AS buys FROM x GROUP BY 1),
  s AS (SELECT x.*, top, buys, v <= 15 AND v <= (top).v * 0.08::double AS dust FROM x JOIN g USING (gid) WHERE top IS NOT NULL AND transaction_type = 'SELL' AND NOT receipt),
  f AS (SELECT arg_min(id, (timestamp, seq)) AS id, any_value((top).coin) AS coin FROM s WHERE NOT dust AND NOT buys GROUP BY gid)
  SELECT id, 'FEE' AS transaction_type, NULL::varchar AS counter_asset FROM s WHERE dust UNION ALL SELECT id, 'BUY', coin FROM f UNION ALL SELECT id, transaction_type, NULL FROM ledger WHERE transaction_type IN ('FEE', 'BUY')""",
}
