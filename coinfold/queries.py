"""The ledger queries by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chain_queries as chain
from . import more_queries as more
from . import stream_queries as streams
from .operators import classifiers as C
from .operators import ledger_ops as L
from .operators import pairing as P
from .operators import staking as K
from .operators import venue_repairs as V
from .plans import uk_cgt as UK
from .plans import us_lots as US
from .sources.testdata import LEDGER_SQL, ledger_from_tpch, rates_from_tpch
from .streaming import pair_stream as PS


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("asset"), F.col("p_retailprice").alias("price"))


def _us(spark: SparkSession, sf_dir: str, method: str = "FIFO") -> DataFrame:
    return US.matches(ledger_from_tpch(spark, sf_dir), method, "USD", rates_from_tpch(spark, sf_dir, "USD"))


def _with_rates(f, to_ccy: str | None = "USD"):
    """A query on the ledger and the day rates to a currency."""
    if to_ccy is None:
        return lambda spark, sf_dir: f(ledger_from_tpch(spark, sf_dir), rates=rates_from_tpch(spark, sf_dir, "GBP"))
    return lambda spark, sf_dir: f(ledger_from_tpch(spark, sf_dir), to_ccy=to_ccy, rates=rates_from_tpch(spark, sf_dir, to_ccy))


def _matches(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = _us(spark, sf_dir, method)
        return m.select("asset", "disposal_id", "lot_id", US.S.quantity(F.col("qty_u")).alias("quantity"), US.S.money(F.col("proceeds_c")).alias("proceeds"), US.S.money(F.col("cost_c")).alias("cost_basis"))

    return run


def _on_fifo(report):
    return lambda spark, sf_dir: report(_us(spark, sf_dir))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = US.lot_events(ledger_from_tpch(spark, sf_dir), "USD", rates_from_tpch(spark, sf_dir, "USD"))
    return US.fifo_open_lots(e)


def _received(x: DataFrame) -> DataFrame:
    """The view as one venue's rows, every other purchase booked as a transfer in."""
    got = (F.col("transaction_type") == "BUY") & (F.pmod("seq", F.lit(2)) == 0)
    x = x.where(got | (F.col("transaction_type") == "SELL"))
    return x.withColumns({"source": F.lit(V.VENUE), "transfer_direction": F.when(got, "IN").otherwise(F.col("transfer_direction")), "transaction_type": F.when(got, "TRANSFER").otherwise(F.col("transaction_type"))})


def _claims(x: DataFrame) -> DataFrame:
    """The first three lines of an order: a token, the native coin, a stablecoin; as trades, as airdrops with their fees, as interest of an app."""
    ln, o = F.pmod("seq", F.lit(10)), F.floor(F.col("seq") / 10)
    trade, app = F.pmod(o, F.lit(4)).isin(0, 2), F.pmod(o, F.lit(4)) == 3
    value = F.when(ln == 2, F.when(o % 5 == 0, 0.0).when(o % 5 == 1, 5.0).otherwise(20.0)).when(o % 7 == 0, 0.0).otherwise(F.col("fiat_value_at_trigger"))
    return x.where(ln.between(1, 3)).withColumns({
        "source": F.when(app, "cryptocom").otherwise("solana"), "id": F.when(app & (o % 8 == 3), F.concat("id", F.lit("-crypto_earn_interest_paid"))).otherwise(F.col("id")), "asset": F.when(ln == 2, "SOL").when(ln == 3, "USDC").otherwise(F.col("asset")),
        "transaction_type": F.when(ln == 3, "TRANSFER").when(app, "AIRDROP").when(trade, F.when(ln == 1, "BUY").otherwise("SELL")).otherwise(F.when(ln == 1, "AIRDROP").otherwise("FEE")),
        "amount": F.when(ln == 2, F.when(o % 3 == 0, 0.01).otherwise(1.0)).otherwise(F.col("amount")), "fiat_value_at_trigger": value, "counter_asset": F.lit("X"),
    })


def _quoted(x: DataFrame) -> DataFrame:
    """The view with every tenth part as a stablecoin whose quantity is its value."""
    stable = F.endswith("asset", F.lit("0"))
    return x.withColumns({"asset": F.when(stable, "USDT").otherwise(F.col("asset")), "amount": F.when(stable, F.col("fiat_value_at_trigger")).otherwise(F.col("amount"))})


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.positions(_lots(spark, sf_dir), _prices(spark, sf_dir))


def _on_ledger(f):
    return lambda spark, sf_dir: f(ledger_from_tpch(spark, sf_dir))


def _engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UK.uk_engine(UK.uk_legs(ledger_from_tpch(spark, sf_dir), rates_from_tpch(spark, sf_dir, "GBP")))


def _cgt(kind: str):
    d = lambda c: F.col(c).cast("double").alias(c)
    return lambda spark, sf_dir: UK.cgt_rows(_engine(spark, sf_dir)).where(F.col("match_type") == kind).select("asset", "day", "tax_year", "disposal_id", "acquisition_id", *map(d, ("quantity", "proceeds", "cost", "gain")))


def _reporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reporting_value(ledger_from_tpch(spark, sf_dir), "GBP", rates_from_tpch(spark, sf_dir, "GBP")).select("id", "from_ccy", "fx_day", "value")


def _same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = UK.same_day_events(UK.uk_legs(ledger_from_tpch(spark, sf_dir)))
    return e.select("asset", "day", "kind", F.col("quantity").cast("double").alias("quantity"), "n_legs", "ids")


def _doubled(ledger: DataFrame) -> DataFrame:
    """The ledger with copies as imports make them: same rows again, and the same content under other ids."""
    again = ledger.where(F.pmod("seq", F.lit(10)) == 0)
    other = ledger.where(F.pmod("seq", F.lit(10)) == 1).withColumn("id", F.concat("id", F.lit("-b")))
    return ledger.unionByName(again).unionByName(other)


def _new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ledger_from_tpch(spark, sf_dir)
    return L.new_rows(x, x.where(F.pmod("seq", F.lit(3)) == 0)).select("id", "asset", "seq")


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ledger_from_tpch(spark, sf_dir)
    o = L.orphan_inflows(x.withColumn("fiat_value_at_trigger", F.lit(0.0))).select(F.col("id").alias("anchor_id"), F.col("timestamp").alias("acquired_at"), (F.col("amount") * 10).alias("total_fiat"))
    return L.with_overrides(x, o).select("id", "transaction_type", "transfer_pair_id", F.col("fiat_value_at_trigger").alias("value"))


def _less_fee(x: DataFrame) -> DataFrame:
    """Every third row has one amount, and transfers in come 0.01 % too much or up to 1.2 % short."""
    a = F.when(F.pmod("seq", F.lit(3)) == 0, 20.0).otherwise(F.col("amount"))
    return x.withColumn("amount", F.when(F.col("transfer_direction") == "IN", a * (F.lit(1.0001) - F.pmod("seq", F.lit(4)) * F.lit(0.004))).otherwise(a))


def _shared_group(x: DataFrame) -> DataFrame:
    """Transfers of few assets under shared on-chain ids; those in come a little short."""
    return _less_fee(more._fewer(x)).withColumn("on_chain_tx_id", F.concat(F.lit("h"), F.pmod("seq", F.lit(60))))


def _earn(x: DataFrame) -> DataFrame:
    """Transfers of few assets as an earn account's deposits and withdrawals."""
    mark = F.when(F.col("transfer_direction") == "OUT", "crypto_earn_program_created-").otherwise("crypto_earn_program_withdrawn-")
    return _less_fee(more._fewer(x)).withColumn("id", F.concat(mark, "id"))


def _dex(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return L.dex_price(li.select(F.concat(F.lit("P"), "l_partkey").alias("asset"), F.col("l_extendedprice").alias("price"), F.col("l_quantity") * 100).toDF("asset", "price", "liquidity"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ledger_from_tpch(spark, sf_dir)
    days = x.groupBy(F.concat_ws("/", "source", "asset").alias("key"), F.to_date("timestamp").alias("start_day")).agg(F.to_date(F.max("timestamp")).alias("end_day"))
    return L.coverage_gaps(days)


def _zones(x: DataFrame) -> DataFrame:
    """Each tenth row once more, an hour later, as an export in another time zone has it."""
    x = x.withColumn("source", F.lit("binance")).withColumn("fee_fiat", F.lit(0.0))
    late = x.where(F.pmod("seq", F.lit(10)) == 0).withColumns({"id": F.concat("id", F.lit("-tz")), "timestamp": F.col("timestamp") + F.expr("interval 1 hour")})
    return C.timezone_copies(x.unionByName(late)).select("id", "asset", "timestamp")


def _pair_values(x: DataFrame) -> DataFrame:
    x = x.where("transaction_type = 'TRANSFER'").withColumn("transfer_pair_id", F.col("trade_group_id")).withColumn("fiat_value_at_trigger", F.when(F.col("transfer_direction") == "OUT", F.col("fiat_value_at_trigger")).otherwise(0.0))
    return C.pair_values(x).select("id", "transfer_pair_id", F.col("fiat_value_at_trigger").alias("value"), "fiat_currency")


QUERIES = {
    "ledger_view": _on_ledger(lambda x: x.select("id", "timestamp", "asset", "transaction_type", "amount", "fiat_value_at_trigger", "fee_fiat", "fiat_currency", "source", "transfer_direction", "instrument_kind", "seq")),
    "reporting_value": _reporting,
    "perp_spot_split": _on_ledger(lambda x: x.groupBy(L.S.is_perp(F.col("instrument_kind"), F.col("source")).alias("is_perp"), "transaction_type").agg(F.count("*").alias("n"))),
    "dust_filter": _on_ledger(lambda x: x.where(~L.is_dust(5.0, 5000.0)).select("id", "asset", "amount")),
    "dedup3": _on_ledger(lambda x: L.dedup(_doubled(x)).select("id", "asset", "seq")),
    "novel_rows": _new_rows,
    "fifo_matches": _matches("FIFO"),
    "lifo_matches": _matches("LIFO"),
    "hifo_matches": _matches("HIFO"),
    "form8949": _on_fifo(lambda m: US.form_8949(m).withColumns({"date_acquired": F.coalesce(F.col("date_acquired").cast("string"), F.lit("UNKNOWN")), "date_sold": F.col("date_sold").cast("string")})),
    "realized_by_asset": _on_fifo(US.realized_by_asset),
    "realized_by_year_term": _on_fifo(US.realized_by_year_term),
    "term_rollup": _on_fifo(lambda m: US.realized_by_year_term(m, True).withColumns({"year": F.coalesce(F.col("year").cast("string"), F.lit("all")), "term": F.coalesce("term", F.lit("all"))})),
    "open_lots": lambda s, d: _lots(s, d).select("asset", "id", US.S.quantity(F.col("qty_u")).alias("quantity"), US.S.money(F.col("cost_c")).alias("cost")),
    "positions": _positions,
    "top_positions": lambda s, d: _positions(s, d).orderBy(F.col("market_value").desc(), "asset").limit(20).select("asset", "market_value"),
    "harvest_uk": lambda s, d: US.harvest_uk(_positions(s, d)),
    "harvest_us": lambda s, d: US.harvest_us(_lots(s, d), _prices(s, d), "2001-12-31"),
    "same_day_events": _same_day,
    "same_day_matches": _cgt("same_day"),
    "thirty_day_matches": _cgt("thirty_day"),
    "on_chain_pairs": _on_ledger(lambda x: P.on_chain_pairs(_shared_group(x))),
    "earn_pairs": _on_ledger(lambda x: P.earn_pairs(_earn(x), 40)),
    "s104_matches": _cgt("section_104"),
    "uk_pools": lambda s, d: UK.pools(_engine(s, d)),
    "uk_cgt_by_year": lambda s, d: UK.cgt_by_year(UK.cgt_rows(_engine(s, d))),
    "income_by_year": _with_rates(L.income_by_year, None),
    "perps_summary": _with_rates(L.perps_summary),
    "swap_net_flows": _with_rates(L.net_flows),
    "swap_basis": _on_ledger(lambda x: L.swap_basis(x.withColumn("fiat_value_at_trigger", F.when(F.col("transaction_type") == "BUY", 0.0).otherwise(F.col("fiat_value_at_trigger")))).where("transaction_type = 'BUY'").select("id", F.col("fiat_value_at_trigger").alias("value"))),
    "fork_quantity": _on_ledger(lambda x: L.fork_quantity(x, "P1", "1999-01-01")),
    "coverage_gaps": _gaps,
    "import_overlaps": _on_ledger(L.import_overlaps),
    "orphan_inflows": _on_ledger(lambda x: L.orphan_inflows(x.withColumn("fiat_value_at_trigger", F.lit(0.0))).select("id", "asset", "amount")),
    "override_injection": _overrides,
    "asof_price": _on_ledger(L.last_price),
    "transfer_candidates": _on_ledger(lambda x: P.transfer_candidates(_less_fee(more._fewer(x)), 24 * 3).select("asset", "out_id", "in_id", "score")),
    "streamed_pairs": _on_ledger(lambda x: PS.replayed(_less_fee(more._fewer(x)), streams.folder(x.sparkSession), 24 * 3)),
    "transfer_pairs": _on_ledger(lambda x: P.transfer_pairs(_less_fee(more._fewer(x)), 24 * 3)),
    "staking_echoes": _on_ledger(lambda x: P.staking_echoes(more._fewer(x), 24 * 9)),
    "ledger_search": _on_ledger(lambda x: L.search(x, "sell", "V3", hide_dust=False).select("id", "asset", "seq")),
    "leg_groups": _with_rates(L.leg_groups),
    "staking_summary": _with_rates(K.summary, "GBP"),
    "dex_price": _dex,
    "liquidity_events": _on_ledger(lambda x: C.liquidity_for_tax(x).where("event_subtype is not null").select("id", "asset", "transaction_type", "event_subtype", F.col("fiat_value_at_trigger").alias("value"))),
    "retyped_income": _on_ledger(lambda x: C.income(_claims(x)).select("id", "asset", "transaction_type", "counter_asset", F.col("fiat_value_at_trigger").alias("value"))),
    "income_retyped": _on_ledger(lambda x: C.income(x.withColumn("source", F.lit("solana")).withColumn("asset", F.when(F.pmod("seq", F.lit(2)) == 0, "SOL").otherwise(F.col("asset")))).groupBy("transaction_type").agg(F.count("*").alias("n"))),
    "spend_receive": _on_ledger(lambda x: V.spend_receive(_received(x)).where("transaction_type = 'BUY'").select("id", F.col("fiat_value_at_trigger").alias("value"))),
    "stable_quotes": _on_ledger(lambda x: V.stable_quotes(_quoted(x)).select("id", "asset", "counter_asset")),
    "lending_for_tax": _on_ledger(lambda x: C.lending_for_tax(x.withColumn("counterparty_address", F.when(F.pmod("seq", F.lit(2)) == 0, C.LENDING_PROGRAMS[0]))).where("event_subtype is not null").select("id", "transaction_type", "event_subtype")),
    "timezone_copies": _on_ledger(_zones),
    "mistyped_transfers": _on_ledger(lambda x: P.mistyped_transfers(more._fewer(x), 60 * 24)),
    "perp_schedule": _with_rates(L.perp_schedule, "GBP"),
    "pair_values": _on_ledger(_pair_values),
}

_LOT_SQL = (
    "WITH"
    + LEDGER_SQL
    + """,
ev AS (
  SELECT id, asset, timestamp, gid, CASE WHEN transaction_type IN ('BUY','AIRDROP','STAKING') OR dir = 'IN' THEN 1 ELSE -1 END AS sign, (amount * 1e8)::hugeint AS q,
    (round(fiat::decimal(24,6) * usd, 2) * 100)::hugeint AS v, (round(fee::decimal(24,6) * usd, 2) * 100)::hugeint AS f, transaction_type FROM ledger WHERE kind IS NULL AND amount > 0),
e AS (SELECT id, asset, timestamp, gid, sign, q, CASE WHEN sign > 0 THEN v + f WHEN transaction_type = 'FEE' THEN v ELSE v - f END AS v FROM ev),
net AS (SELECT *, sum(sign * q) OVER w AS net FROM e WINDOW w AS (PARTITION BY asset ORDER BY timestamp, gid, sign DESC, id ROWS UNBOUNDED PRECEDING)),
low AS (SELECT *, greatest(0, -min(net) OVER w) AS u FROM net WINDOW w AS (PARTITION BY asset ORDER BY timestamp, gid, sign DESC, id ROWS UNBOUNDED PRECEDING)),
bare AS (SELECT *, CASE WHEN sign < 0 THEN u - coalesce(lag(u) OVER w, 0) ELSE 0 END AS bare FROM low WINDOW w AS (PARTITION BY asset ORDER BY timestamp, gid, sign DESC, id)),
ax AS (SELECT *, sum(q - bare) OVER w AS hi, sum(q - bare) OVER w - (q - bare) AS lo FROM bare WINDOW w AS (PARTITION BY asset, sign ORDER BY timestamp, gid, id ROWS UNBOUNDED PRECEDING)),
m0 AS (
  SELECT d.asset, d.id AS disposal_id, a.id AS lot_id, a.timestamp AS acquired, d.timestamp AS disposed, (least(a.hi, d.hi) - greatest(a.lo, d.lo))::hugeint AS qu, d.v AS dv, d.q AS dq, a.v AS av, a.q AS aq
  FROM ax d JOIN ax a ON a.asset = d.asset AND a.sign = 1 AND d.sign = -1 AND least(a.hi, d.hi) > greatest(a.lo, d.lo)
  UNION ALL SELECT asset, id, NULL, NULL, timestamp, bare::hugeint, v, q, 0, 1 FROM ax WHERE bare > 0),
m AS (
  SELECT asset, disposal_id, lot_id, acquired, disposed, qu, (sign(dv) * ((2 * abs(dv) * qu + dq) // (2 * dq)))::hugeint AS p, ((2 * av * qu + aq) // (2 * aq))::hugeint AS c,
    CASE WHEN acquired IS NULL THEN 'SHORT' WHEN disposed::date >= (acquired::date + INTERVAL 12 MONTH)::date + 1 THEN 'LONG' ELSE 'SHORT' END AS term FROM m0 WHERE qu > 100),
lots AS (
  SELECT asset, id, timestamp, q - coalesce(used, 0) AS qu, ((2 * v * (q - coalesce(used, 0)) + q) // (2 * q))::hugeint AS c
  FROM e LEFT JOIN (SELECT lot_id, sum(qu) AS used FROM m GROUP BY 1) ON lot_id = id WHERE sign = 1 AND q - coalesce(used, 0) > 100),
price AS (SELECT 'P' || p_partkey AS asset, p_retailprice AS price FROM part),
pos0 AS (
  SELECT asset, count(*) AS n_lots, min(timestamp) AS first_acquired, sum(qu) AS q, sum(c) AS c FROM lots GROUP BY 1),
pos AS (SELECT pos0.*, round((q::decimal(38,0) * price::decimal(18,2))::decimal(38,2) / 1000000)::hugeint AS v FROM pos0 LEFT JOIN price USING (asset))
"""
)
_L = "WITH" + LEDGER_SQL
_UK_SQL = (
    _L
    + """, u AS (
  SELECT id, asset, timestamp, (timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')::date AS day, amount::hugeint AS q, CASE WHEN transaction_type IN ('BUY','AIRDROP','STAKING') OR dir = 'IN' THEN 'A' ELSE 'D' END AS side,
    (round(fiat * 100)::hugeint + CASE WHEN transaction_type IN ('BUY','AIRDROP','STAKING') OR dir = 'IN' THEN 1 WHEN transaction_type = 'FEE' THEN 0 ELSE -1 END * round(fee * 100)::hugeint) * (gbp * 100000000)::hugeint AS v
  FROM ledger WHERE kind IS NULL),
  day AS (SELECT asset, day, side, sum(q) AS q, sum(v) AS v, string_agg(id, '+' ORDER BY timestamp, id) AS ids FROM u GROUP BY 1, 2, 3)"""
)
SQL = {
    "ledger_view": _L + " SELECT id, timestamp, asset, transaction_type, amount, fiat AS fiat_value_at_trigger, fee AS fee_fiat, ccy AS fiat_currency, source, dir AS transfer_direction, kind AS instrument_kind, seq FROM ledger",
    "reporting_value": _L
    + " SELECT id, from_ccy, timestamp::date AS fx_day, (round(fiat::decimal(24,6) * gbp, 2) * 100)::hugeint / 100.0::double AS value FROM ledger",
    "perp_spot_split": _L + " SELECT kind IS NOT NULL AS is_perp, transaction_type, count(*) AS n FROM ledger GROUP BY 1, 2",
    "dust_filter": _L + " SELECT id, asset, amount FROM ledger WHERE NOT (amount < 5 OR (fiat > 0 AND fiat < 5000))",
    "dedup3": _L
    + """, x AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE seq % 10 = 0 UNION ALL SELECT * REPLACE (id || '-b' AS id) FROM ledger WHERE seq % 10 = 1),
  a AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY fiat DESC, timestamp, seq, id) = 1)
  SELECT id, asset, seq FROM a QUALIFY row_number() OVER (PARTITION BY timestamp, asset, transaction_type, round(amount, 8), round(fiat, 2), source, dir, gid ORDER BY fiat DESC, timestamp, seq, id) = 1""",
    "novel_rows": _L + ", p AS (SELECT * FROM ledger WHERE seq % 3 = 0) SELECT id, asset, seq FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = l.id) AND NOT EXISTS (SELECT 1 FROM p WHERE p.timestamp = l.timestamp AND p.asset = l.asset AND p.transaction_type = l.transaction_type AND p.amount = l.amount AND p.source = l.source)",
    "fifo_matches": _LOT_SQL + "SELECT asset, disposal_id, lot_id, qu / 1e8 AS quantity, p / 100.0::double AS proceeds, c / 100.0::double AS cost_basis FROM m",
    "form8949": _LOT_SQL + "SELECT asset, disposal_id, lot_id, coalesce(strftime(acquired, '%Y-%m-%d'), 'UNKNOWN') AS date_acquired, strftime(disposed, '%Y-%m-%d') AS date_sold, qu / 1e8 AS quantity, p / 100.0::double AS proceeds, c / 100.0::double AS cost_basis, (p - c) / 100.0::double AS gain_loss, term FROM m",
    "realized_by_asset": _LOT_SQL
    + "SELECT asset, count(*) AS n_rows, sum(qu) / 1e8 AS quantity, sum(p) / 100.0::double AS proceeds, sum(c) / 100.0::double AS cost_basis, (sum(p) - sum(c)) / 100.0::double AS realized_pnl, CASE WHEN sum(c) > 0 THEN round((sum(p) - sum(c)) * 10000 / sum(c)) / 100.0::double + 0 ELSE 0 END AS realized_pct FROM m GROUP BY 1",
    "realized_by_year_term": _LOT_SQL + "SELECT year(disposed)::int AS year, term, count(*) AS n_rows, sum(p) / 100.0::double AS proceeds, sum(c) / 100.0::double AS cost_basis, (sum(p) - sum(c)) / 100.0::double AS gain_loss FROM m GROUP BY 1, 2",
    "term_rollup": _LOT_SQL + "SELECT coalesce(year(disposed)::int::varchar, 'all') AS year, coalesce(term, 'all') AS term, count(*) AS n_rows, sum(p) / 100.0::double AS proceeds, sum(c) / 100.0::double AS cost_basis, (sum(p) - sum(c)) / 100.0::double AS gain_loss FROM m GROUP BY ROLLUP (year(disposed)::int, term)",
    "open_lots": _LOT_SQL + "SELECT asset, id, qu / 1e8 AS quantity, c / 100.0::double AS cost FROM lots",
    "positions": _LOT_SQL + "SELECT asset, n_lots, first_acquired, q / 1e8 AS quantity, c / 100.0::double AS invested, v / 100.0::double AS market_value, (v - c) / 100.0::double AS unrealized FROM pos",
    "top_positions": _LOT_SQL + "SELECT asset, v / 100.0::double AS market_value FROM pos ORDER BY v DESC, asset LIMIT 20",
    "harvest_uk": _LOT_SQL
    + """, l AS (SELECT asset, (c - v) / 100.0::double::decimal(20,2) AS x, (c - v)::bigint AS loss FROM pos WHERE v < c),
  b AS (SELECT asset, loss, least(loss, greatest(3770000 - coalesce(sum(loss) OVER (ORDER BY loss DESC, asset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS basic FROM l)
  SELECT asset, loss / 100.0::double AS loss, basic / 100.0::double AS at_basic, ((2 * (basic * 18 + (loss - basic) * 24) + 100) // 200) / 100.0::double AS tax_saved FROM b""",
    "same_day_events": _L
    + """, u AS (SELECT id, asset, timestamp, (timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')::date AS day, amount, CASE WHEN transaction_type IN ('BUY','AIRDROP','STAKING') OR dir = 'IN' THEN 'A' ELSE 'D' END AS kind FROM ledger l WHERE l.kind IS NULL)
  SELECT asset, day, kind, sum(amount) AS quantity, count(*) AS n_legs, string_agg(id, '+' ORDER BY timestamp, id) AS ids FROM u GROUP BY 1, 2, 3""",
    "swap_net_flows": _L
    + """, x AS (SELECT gid, asset, CASE WHEN transaction_type IN ('BUY','AIRDROP','STAKING') OR dir = 'IN' THEN 1 ELSE 0 END AS i, (amount * 1e8)::hugeint AS q, (round(fiat::decimal(24,6) * usd, 2) * 100)::hugeint AS v FROM ledger)
  SELECT gid AS trade_group_id, asset, count(*) AS n_legs, sum((2 * i - 1) * q) / 1e8 AS net_quantity, sum(i * v) / 100.0::double AS value_in, sum((1 - i) * v) / 100.0::double AS value_out FROM x GROUP BY 1, 2""",
    "fork_quantity": _L
    + " SELECT asset, sum(CASE WHEN transaction_type IN ('BUY','AIRDROP','STAKING') OR dir = 'IN' THEN amount ELSE -amount END) AS quantity FROM ledger WHERE asset = 'P1' AND timestamp < '1999-01-01' AND kind IS NULL GROUP BY 1",
    "perps_summary": _L
    + """ SELECT source, count(*) AS fills, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum((round(pnl::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS pnl,
  sum((round(fee::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS fee, sum((round(fiat::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS notional FROM ledger WHERE kind = 'perp' GROUP BY 1""",
    "coverage_gaps": _L
    + """, d AS (SELECT DISTINCT source || '/' || asset AS key, timestamp::date AS day FROM ledger), g AS (SELECT key, day, lag(day) OVER (PARTITION BY key ORDER BY day) AS before FROM d)
  SELECT key, before AS gap_start, day AS gap_end, (day - before)::int AS gap_days FROM g WHERE day - before >= 7""",
    "import_overlaps": _L
    + """, r AS (SELECT import_id, min(timestamp)::date AS a, max(timestamp)::date AS b, min(source) AS source FROM (SELECT *, count(*) OVER (PARTITION BY import_id, source) AS n FROM ledger) GROUP BY 1),
  src AS (SELECT import_id, source FROM (SELECT import_id, source, count(*) AS n FROM ledger GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY n DESC, source) = 1),
  i AS (SELECT r.import_id, a, b, src.source FROM r JOIN src USING (import_id)),
  k AS (SELECT DISTINCT import_id, timestamp::date AS day, asset, transaction_type, amount FROM ledger),
  s AS (SELECT x.import_id AS a_id, y.import_id AS b_id, count(*) AS shared FROM k x JOIN k y ON x.day = y.day AND x.asset = y.asset AND x.transaction_type = y.transaction_type AND x.amount = y.amount AND x.import_id < y.import_id GROUP BY 1, 2)
  SELECT x.source, x.import_id AS a_id, y.import_id AS b_id, (least(x.b, y.b) - greatest(x.a, y.a) + 1)::int AS overlap_days, coalesce(shared, 0) AS shared
  FROM i x JOIN i y ON x.source = y.source AND x.import_id < y.import_id AND x.a <= y.b AND y.a <= x.b LEFT JOIN s ON s.a_id = x.import_id AND s.b_id = y.import_id""",
    "orphan_inflows": _L + " SELECT id, asset, amount FROM ledger WHERE dir = 'IN'",
    "override_injection": _L
    + """ SELECT id, transaction_type, CASE WHEN dir = 'IN' THEN 'manual-basis-' || id END AS transfer_pair_id, fiat AS value FROM ledger
  UNION ALL SELECT 'manual-buy-' || id, 'BUY', NULL, amount * 10 FROM ledger WHERE dir = 'IN'""",
    "asof_price": _L
    + """, b AS (SELECT asset, timestamp, arg_max(fiat / amount, id) AS price FROM ledger WHERE transaction_type = 'BUY' GROUP BY 1, 2)
  SELECT s.id, s.asset, s.timestamp, b.timestamp AS price_at, b.price AS last_price FROM (SELECT * FROM ledger WHERE transaction_type = 'SELL') s ASOF LEFT JOIN b ON s.asset = b.asset AND s.timestamp >= b.timestamp""",
    "transfer_candidates": more._F
    + """, t AS (SELECT *, epoch(timestamp) AS at, CASE WHEN dir = 'IN' THEN (CASE WHEN seq % 3 = 0 THEN 20 ELSE amount END) * (1.0001::double - (seq % 4) * 0.004::double) WHEN seq % 3 = 0 THEN 20 ELSE amount END AS a FROM ledger WHERE transaction_type = 'TRANSFER')
  SELECT o.asset, o.id AS out_id, i.id AS in_id, abs(o.a - i.a) * 1000000 + abs(i.at - o.at)::double AS score FROM t o JOIN t i ON o.asset = i.asset AND o.dir = 'OUT' AND i.dir = 'IN' AND o.source <> i.source AND abs(i.at - o.at) <= 259200
    AND i.a <= o.a * 1.0005::double AND o.a - i.a <= greatest(o.a * 0.01::double, 1e-8::double) AND o.a - i.a <= o.a * 0.02::double""",
    "staking_echoes": more._F
    + " SELECT DISTINCT o.id FROM ledger o JOIN ledger s ON o.dir = 'OUT' AND s.transaction_type = 'STAKING' AND o.asset = s.asset AND o.source = s.source AND epoch(o.timestamp) - epoch(s.timestamp) BETWEEN 0 AND 777600 AND abs(o.amount - s.amount) <= greatest(o.amount, s.amount) * 0.02::double",
    "ledger_search": _L + " SELECT id, asset, seq FROM ledger WHERE source = 'V3' AND contains(lower(concat_ws(' ', id, asset, transaction_type, source, gid)), 'sell')",
    "leg_groups": _L
    + """ SELECT gid AS group_key, count(*) AS n_legs, count(DISTINCT asset) AS n_assets, min(timestamp) AS first_at, arg_min(transaction_type, CASE transaction_type WHEN 'SELL' THEN 1 WHEN 'BUY' THEN 2 WHEN 'STAKING' THEN 3 WHEN 'AIRDROP' THEN 4 WHEN 'TRANSFER' THEN 5 ELSE 6 END) AS primary_type,
  sum((round(fiat::decimal(24,6) * usd, 2) * 100)::hugeint) / 100.0::double AS value FROM ledger GROUP BY 1 HAVING count(*) >= 2""",
    "same_day_matches": _UK_SQL
    + """ SELECT a.asset, a.day, (year(a.day) - CASE WHEN strftime(a.day, '%m%d') < '0406' THEN 1 ELSE 0 END) || '/' || lpad(((year(a.day) - CASE WHEN strftime(a.day, '%m%d') < '0406' THEN 1 ELSE 0 END + 1) % 100)::varchar, 2, '0') AS tax_year, d.ids AS disposal_id, a.ids AS acquisition_id,
  least(a.q, d.q)::double AS quantity, (2 * d.v * least(a.q, d.q) + d.q * 100000000) // (2 * d.q * 100000000) / 100.0::double AS proceeds, (2 * a.v * least(a.q, d.q) + a.q * 100000000) // (2 * a.q * 100000000) / 100.0::double AS cost,
  ((2 * d.v * least(a.q, d.q) + d.q * 100000000) // (2 * d.q * 100000000) - (2 * a.v * least(a.q, d.q) + a.q * 100000000) // (2 * a.q * 100000000)) / 100.0::double AS gain FROM day a JOIN day d ON a.asset = d.asset AND a.day = d.day AND a.side = 'A' AND d.side = 'D'""",
    "income_by_year": _L
    + """, i AS (SELECT *, timestamp::date AS day FROM ledger WHERE transaction_type IN ('AIRDROP', 'STAKING') AND amount > 0)
  SELECT (year(day) - CASE WHEN strftime(day, '%m%d') < '0406' THEN 1 ELSE 0 END) || '/' || lpad(((year(day) - CASE WHEN strftime(day, '%m%d') < '0406' THEN 1 ELSE 0 END + 1) % 100)::varchar, 2, '0') AS tax_year, transaction_type, count(*) AS n_rows,
  sum((round(fiat::decimal(24,6) * gbp, 2) * 100)::hugeint) / 100.0::double AS income FROM i GROUP BY 1, 2""",
    "harvest_us": _LOT_SQL
    + """, h AS (SELECT asset, round((qu::decimal(38,0) * price::decimal(18,2))::decimal(38,2) / 1000000)::hugeint - c AS g, CASE WHEN DATE '2001-12-31' >= (timestamp::date + INTERVAL 12 MONTH)::date + 1 THEN 1 ELSE 0 END AS long FROM lots JOIN price USING (asset)),
  t AS (SELECT asset, sum(g * (1 - long))::hugeint AS s, sum(g * long)::hugeint AS l FROM h GROUP BY 1), x AS (SELECT *, sign(s * 24 + l * 15) * ((2 * abs(s * 24 + l * 15) + 100) // 200) AS tax FROM t)
  SELECT asset, s / 100.0::double AS short_term, l / 100.0::double AS long_term, tax / 100.0::double + 0 AS tax_if_sold, greatest(-tax, 0) / 100.0::double AS tax_saved FROM x""",
    "swap_basis": _L
    + """ SELECT id, CASE WHEN s > 0 THEN (2 * s * amount::hugeint + q) // (2 * q) / 100.0::double ELSE 0 END AS value
  FROM (SELECT *, (sum(round(fiat * 100)::hugeint) FILTER (transaction_type = 'SELL') OVER (PARTITION BY gid))::hugeint AS s, (sum(amount::hugeint) FILTER (transaction_type = 'BUY') OVER (PARTITION BY gid))::hugeint AS q FROM ledger) WHERE transaction_type = 'BUY'""",
    "liquidity_events": _L
    + """, x AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN transaction_type = 'TRANSFER' THEN dir WHEN transaction_type = 'SELL' THEN 'OUT' WHEN transaction_type = 'BUY' THEN 'IN' END END AS way FROM ledger),
  g AS (SELECT gid, CASE WHEN count(*) FILTER (way = 'IN') = 0 AND count(*) FILTER (way = 'OUT') >= 2 THEN 'lp_add' WHEN count(*) FILTER (way = 'OUT') = 0 AND count(*) FILTER (way = 'IN') >= 2 THEN 'lp_remove' END AS ev, round(sum(fiat::decimal(18,2)) FILTER (way IS NOT NULL), 2)::double AS total FROM x GROUP BY 1)
  SELECT id, asset, CASE way WHEN 'OUT' THEN 'SELL' ELSE 'BUY' END AS transaction_type, ev AS event_subtype, fiat AS value FROM x JOIN g USING (gid) WHERE ev IS NOT NULL AND way IS NOT NULL
  UNION ALL SELECT 'lp-acquire-' || gid, 'LP:' || gid, 'BUY', 'lp_add', total FROM g WHERE ev = 'lp_add'""",
    "spend_receive": _L
    + """, k AS (SELECT id, gid, amount, fiat, transaction_type = 'SELL' AS spend FROM ledger WHERE transaction_type = 'SELL' OR transaction_type = 'BUY' AND seq % 2 = 0),
  t AS (SELECT *, (sum(round(fiat * 100)::hugeint) FILTER (spend) OVER (PARTITION BY gid))::hugeint AS s, (sum(amount::hugeint) FILTER (NOT spend) OVER (PARTITION BY gid))::hugeint AS q FROM k)
  SELECT id, (2 * s * amount::hugeint + q) // (2 * q) / 100.0::double AS value FROM t WHERE NOT spend AND s > 0""",
    "stable_quotes": _L
    + """, x AS (SELECT *, CASE WHEN asset LIKE '%0' THEN 'USDT' ELSE asset END AS a, asset LIKE '%0' AS stable FROM ledger),
  m AS (SELECT c.id, min(s.id) AS leg FROM x c JOIN x s ON c.timestamp = s.timestamp AND c.source = s.source AND NOT c.stable AND s.stable AND abs(s.fiat - c.fiat) <= greatest(s.fiat, c.fiat) * 0.02
    AND (c.transaction_type = 'SELL' AND s.transaction_type = 'BUY' OR c.transaction_type = 'BUY' AND s.transaction_type = 'SELL') GROUP BY 1)
  SELECT x.id, a AS asset, CASE WHEN m.id IS NOT NULL THEN 'USDT' END AS counter_asset FROM x LEFT JOIN m USING (id) WHERE x.id NOT IN (SELECT leg FROM m)""",
    "lending_for_tax": _L + " SELECT id, CASE dir WHEN 'OUT' THEN 'SELL' ELSE 'BUY' END AS transaction_type, CASE dir WHEN 'OUT' THEN 'lend_deposit' ELSE 'lend_withdraw' END AS event_subtype FROM ledger WHERE dir IS NOT NULL AND seq % 2 = 0",
    "timezone_copies": _L + " SELECT id, asset, timestamp FROM ledger",
    "perp_schedule": _L
    + """, n AS (SELECT year(timestamp)::int AS year, (round(pnl::decimal(24,6) * gbp, 2) * 100)::hugeint - (round(fee::decimal(24,6) * gbp, 2) * 100)::hugeint AS net FROM ledger WHERE kind = 'perp' AND pnl IS NOT NULL)
  SELECT year, count(*) AS n, sum(greatest(net, 0)) / 100.0::double AS gains, sum(greatest(-net, 0)) / 100.0::double AS losses FROM n GROUP BY 1""",
    "pair_values": _L
    + """, t AS (SELECT *, max(CASE WHEN dir = 'OUT' THEN {'v': fiat, 'a': amount, 'c': ccy} END) OVER (PARTITION BY gid) AS d FROM ledger WHERE dir IS NOT NULL)
  SELECT id, gid AS transfer_pair_id, CASE WHEN dir = 'OUT' THEN fiat WHEN d IS NULL THEN 0 ELSE (2 * round(d.v * 100)::hugeint * amount::hugeint + d.a::hugeint) // (2 * d.a::hugeint) / 100.0::double END AS value, CASE WHEN dir = 'OUT' OR d IS NULL THEN ccy ELSE d.c END AS fiat_currency FROM t""",
    "staking_summary": _L
    + """ SELECT asset, (year(timestamp) - CASE WHEN strftime(timestamp, '%m%d') < '0406' THEN 1 ELSE 0 END) || '/' || lpad(((year(timestamp) - CASE WHEN strftime(timestamp, '%m%d') < '0406' THEN 1 ELSE 0 END + 1) % 100)::varchar, 2, '0') AS tax_year,
  count(*) AS n_events, sum(amount) AS quantity, sum((round(fiat::decimal(24,6) * gbp, 2) * 100)::hugeint) / 100.0::double AS value, min(timestamp) AS first_at FROM ledger WHERE transaction_type = 'STAKING' GROUP BY 1, 2""",
    "dex_price": """WITH p AS (SELECT 'P' || l_partkey AS asset, l_extendedprice AS price, l_quantity * 100 AS liq FROM lineitem WHERE l_quantity >= 10),
  r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY price, liq) AS r, count(*) OVER (PARTITION BY asset) AS n FROM p), m AS (SELECT asset, max(price) FILTER (r = n // 2 + 1) AS mid FROM r GROUP BY 1)
  SELECT asset, count(*) AS n_pairs, sum(price::decimal(18,6) * liq::decimal(18,2))::double / sum(liq::decimal(18,2))::double AS price FROM r JOIN m USING (asset) WHERE price BETWEEN mid / 5 AND mid * 5 GROUP BY 1""",
}
QUERIES |= more.QUERIES | chain.QUERIES | streams.QUERIES
SQL |= more.SQL | chain.SQL | streams.SQL
SQL["realized_by_gain"] = _LOT_SQL + "SELECT asset, (sum(p) - sum(c)) / 100.0::double AS realized_pnl FROM m GROUP BY 1 ORDER BY abs(sum(p) - sum(c)) DESC, asset LIMIT 25"
SQL["holdings"] = _LOT_SQL + "SELECT count(*) AS n, sum(c) / 100.0::double AS invested, sum(v) / 100.0::double AS market_value, (sum(v) - sum(c)) / 100.0::double AS gain, round((sum(v) - sum(c)) * 10000.0::double / sum(c)) / 100 AS gain_percent FROM pos"
SQL["ordered_overlaps"] = SQL["import_overlaps"].replace("SELECT x.source, x.import_id", "SELECT CASE WHEN shared > 0 THEN 'duplicate' ELSE 'dates' END AS kind, x.source, x.import_id")

#: Each leg out, in order of time, takes the best leg in that is left: a step for the n-th leg out of every asset.
_GREEDY = """, o AS (SELECT asset, out_id, list(in_id ORDER BY score, in_id) AS cands, row_number() OVER (PARTITION BY asset ORDER BY out_at, out_id) AS n FROM c GROUP BY asset, out_id, out_at),
  r(asset, n, used, out_id, pick) AS (
    SELECT DISTINCT asset, 0::bigint, []::varchar[], NULL::varchar, NULL::varchar FROM o
    UNION ALL SELECT asset, n, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, out_id, p FROM (
      SELECT r.asset, o.n, r.used, o.out_id, list_filter(o.cands, lambda x: NOT list_contains(r.used, x))[1] AS p FROM r JOIN o ON o.asset = r.asset AND o.n = r.n + 1))
  SELECT asset, out_id, pick AS in_id, 'pair-' || out_id AS pair_id FROM r WHERE pick IS NOT NULL"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


SQL["transfer_pairs"] = _recursive(SQL["transfer_candidates"].replace("SELECT o.asset, o.id AS out_id", ", c AS (SELECT o.asset, o.at AS out_at, o.id AS out_id") + ")" + _GREEDY)
SQL["mistyped_transfers"] = _recursive(more._F) + """, t AS (SELECT *, epoch(timestamp) AS at FROM ledger WHERE kind IS NULL AND pnl IS NULL), c AS (
  SELECT o.asset, o.id AS out_id, i.id AS in_id, o.at AS out_at, i.at AS score FROM t o JOIN t i ON o.asset = i.asset AND o.transaction_type = 'SELL' AND i.transaction_type = 'BUY' AND o.source <> i.source AND abs(i.at - o.at) <= 86400 AND abs(o.amount - i.amount) <= greatest(o.amount, i.amount) * 1e-6::double)""" + _GREEDY

#: A step takes the lot that is first in the method's order, or goes on to the asset's next event and says what no lot covered.
_PICKED = """, s AS (
  SELECT *, row_number() OVER (PARTITION BY asset ORDER BY timestamp, gid, sign DESC, id) AS n, row_number() OVER (PARTITION BY asset, sign ORDER BY timestamp, gid, id) AS rank FROM e),
pe AS (SELECT *, row_number() OVER (PARTITION BY asset, sign ORDER BY {order}, rank) AS p FROM s), last AS (SELECT asset, max(n) AS n FROM pe GROUP BY 1),
r(asset, n, need, lots, e_n, e_p, e_q) AS (
  SELECT asset, 0::bigint, 0::hugeint, []::struct(p bigint, rest hugeint)[], NULL::bigint, NULL::bigint, NULL::hugeint FROM last
  UNION ALL
  SELECT x.asset, CASE WHEN act THEN x.n ELSE x.n + 1 END, CASE WHEN act THEN need - take WHEN pe.sign < 0 THEN pe.q ELSE 0 END,
    CASE WHEN act THEN list_concat(list_filter(lots, lambda y: y.p <> best.p), CASE WHEN best.rest - take > 100 THEN [{{'p': best.p, 'rest': best.rest - take}}] ELSE [] END) WHEN pe.sign > 0 THEN list_append(lots, {{'p': pe.p, 'rest': pe.q}}) ELSE lots END,
    CASE WHEN act OR need > 100 THEN x.n END, CASE WHEN act THEN best.p END, CASE WHEN act THEN take WHEN need > 100 THEN need END
  FROM (SELECT *, least(need, best.rest) AS take FROM (SELECT *, need > 100 AND len(lots) > 0 AS act, list_sort(lots)[1] AS best FROM r)) x JOIN last ON last.asset = x.asset AND (x.act OR x.n <= last.n)
    LEFT JOIN pe ON NOT x.act AND pe.asset = x.asset AND pe.n = x.n + 1)
SELECT d.asset, d.id AS disposal_id, l.id AS lot_id, e_q / 1e8 AS quantity, (sign(d.v) * ((2 * abs(d.v) * e_q + d.q) // (2 * d.q))) / 100.0::double AS proceeds, coalesce((2 * l.v * e_q + l.q) // (2 * l.q), 0) / 100.0::double AS cost_basis
FROM r JOIN pe d ON d.asset = r.asset AND d.n = e_n LEFT JOIN pe l ON l.asset = r.asset AND l.sign > 0 AND l.p = e_p WHERE e_q IS NOT NULL"""
for _name, _order in (("lifo_matches", "timestamp DESC, v / q::double DESC"), ("hifo_matches", "v / q::double DESC, timestamp")):
    SQL[_name] = _recursive(_LOT_SQL) + _PICKED.format(order=_order)

_TAX_YEAR = "(year({0}) - CASE WHEN strftime({0}, '%m%d') < '0406' THEN 1 ELSE 0 END) || '/' || lpad(((year({0}) - CASE WHEN strftime({0}, '%m%d') < '0406' THEN 1 ELSE 0 END + 1) % 100)::varchar, 2, '0')"
#: UK matching: same day, then a step for each match with the 30 days before or for the next day, then a step for each day of the pool.
#: Values are whole numbers of 1e-10, the pool's cost of 1e-16.
_UK_FOLD = (
    _recursive(_UK_SQL)
    + """, dd AS (
  SELECT asset, day, max(q) FILTER (side = 'A') AS aq, max(v) FILTER (side = 'A') AS av, max(ids) FILTER (side = 'A') AS aid, max(q) FILTER (side = 'D') AS dq, max(v) FILTER (side = 'D') AS dv, max(ids) FILTER (side = 'D') AS did,
    row_number() OVER (PARTITION BY asset ORDER BY day) AS n FROM day GROUP BY asset, day),
  o AS (SELECT *, coalesce(aq, 0) - least(coalesce(aq, 0), coalesce(dq, 0)) AS a0, coalesce(dq, 0) - least(coalesce(aq, 0), coalesce(dq, 0)) AS d0 FROM dd), last AS (SELECT asset, max(n) AS n FROM o GROUP BY 1),
  r(asset, n, day, a, waits, m_d, m_a, m_q) AS (
    SELECT asset, 0::bigint, NULL::date, 0::hugeint, []::struct(n bigint, day date, rest hugeint)[], NULL::bigint, NULL::bigint, NULL::hugeint FROM last
    UNION ALL
    SELECT x.asset, CASE WHEN act THEN x.n ELSE x.n + 1 END, CASE WHEN act THEN x.day ELSE o.day END, CASE WHEN act THEN a - take ELSE o.a0 END,
      CASE WHEN act THEN list_transform(waits, lambda w: CASE WHEN w.n = best.n THEN {'n': w.n, 'day': w.day, 'rest': w.rest - take} ELSE w END)
        ELSE list_concat(list_filter(waits, lambda w: w.rest > 0 AND w.day >= o.day - 30), CASE WHEN o.d0 > 0 THEN [{'n': o.n, 'day': o.day, 'rest': o.d0}] ELSE [] END) END,
      CASE WHEN act THEN best.n END, CASE WHEN act THEN x.n END, CASE WHEN act THEN take END
    FROM (SELECT *, a > 0 AND best IS NOT NULL AS act, least(a, best.rest) AS take FROM (SELECT *, list_filter(waits, lambda w: w.rest > 0 AND w.day < r.day AND w.day >= r.day - 30)[1] AS best FROM r)) x
      JOIN last ON last.asset = x.asset AND (x.act OR x.n < last.n) LEFT JOIN o ON NOT x.act AND o.asset = x.asset AND o.n = x.n + 1),
  m30 AS (SELECT asset, m_d, m_a, m_q FROM r WHERE m_q IS NOT NULL),
  z AS (SELECT o.*, (a0 - coalesce((SELECT sum(m_q) FROM m30 WHERE m30.asset = o.asset AND m_a = o.n), 0))::hugeint AS al, (d0 - coalesce((SELECT sum(m_q) FROM m30 WHERE m30.asset = o.asset AND m_d = o.n), 0))::hugeint AS dl FROM o),
  p(asset, n, q, c, tq, tc) AS (
    SELECT asset, 0::bigint, 0::hugeint, 0::hugeint, 0::hugeint, 0::hugeint FROM last
    UNION ALL
    SELECT asset, n, q1 - t, CASE WHEN q1 - t = 0 THEN 0 ELSE c1 - cut END, t, cut FROM (SELECT *, CASE WHEN t > 0 THEN (2 * c1 * t + q1) // (2 * q1) ELSE 0 END AS cut FROM (
      SELECT *, least(dl, q1) AS t FROM (SELECT z.asset, z.n, z.dl, p.q + z.al AS q1, p.c + CASE WHEN z.al > 0 THEN (2 * z.av * 1000000 * z.al + z.aq) // (2 * z.aq) ELSE 0 END AS c1 FROM p JOIN z ON z.asset = p.asset AND z.n = p.n + 1)))),
  rows_ AS (
    SELECT 'same_day' AS kind, asset, day, did, aid, least(aq, dq) AS q, dv, dq, (2 * av * least(aq, dq) + aq * 100000000) // (2 * aq * 100000000) AS cost FROM o WHERE aq IS NOT NULL AND dq IS NOT NULL
    UNION ALL SELECT 'thirty_day', d.asset, d.day, d.did, a.aid, m_q, d.dv, d.dq, (2 * a.av * m_q + a.aq * 100000000) // (2 * a.aq * 100000000) FROM m30 JOIN o d ON d.asset = m30.asset AND d.n = m_d JOIN o a ON a.asset = m30.asset AND a.n = m_a
    UNION ALL SELECT 'section_104', z.asset, z.day, did, NULL, tq, dv, dq, (2 * tc + 100000000000000) // 200000000000000 FROM p JOIN z ON z.asset = p.asset AND z.n = p.n WHERE tq > 0
    UNION ALL SELECT 'unmatched', z.asset, z.day, did, NULL, dl - tq, dv, dq, 0 FROM p JOIN z ON z.asset = p.asset AND z.n = p.n WHERE dl > tq),
  cgt AS (SELECT *, (2 * dv * q + dq * 100000000) // (2 * dq * 100000000) AS proceeds, """
    + _TAX_YEAR.format("day")
    + " AS tax_year FROM rows_)"
)
for _name, _kind in (("thirty_day_matches", "thirty_day"), ("s104_matches", "section_104")):
    SQL[_name] = _UK_FOLD + f" SELECT asset, day, tax_year, did AS disposal_id, aid AS acquisition_id, q::double AS quantity, proceeds / 100.0::double AS proceeds, cost / 100.0::double AS cost, (proceeds - cost) / 100.0::double AS gain FROM cgt WHERE kind = '{_kind}'"
SQL["streamed_matches"] = _UK_FOLD + " SELECT asset, kind AS match_type, day, did AS disposal_id, aid AS acquisition_id, q::double AS quantity, proceeds / 100.0::double AS proceeds, cost / 100.0::double AS cost FROM cgt"
SQL["uk_pools"] = _UK_FOLD + " SELECT p.asset, q::double AS quantity, ((2 * c + 100000000000000) // 200000000000000) / 100.0::double AS cost FROM p JOIN last USING (asset, n) WHERE q > 0"
_EXEMPT = " ".join(f"WHEN '{y}' THEN {a}" for y, a in US.S.EXEMPT.items())
SQL["uk_cgt_by_year"] = _UK_FOLD + f""", g AS (SELECT tax_year, count(DISTINCT (asset, did)) AS n_disposals, sum(proceeds) AS p, sum(cost) AS c, sum(greatest(proceeds - cost, 0)) AS g, sum(greatest(cost - proceeds, 0)) AS l, CASE tax_year {_EXEMPT} ELSE {US.S.EXEMPT_DEFAULT} END AS e FROM cgt GROUP BY 1)
  SELECT tax_year, n_disposals, p / 100.0::double AS proceeds, c / 100.0::double AS allowable_cost, g / 100.0::double AS gains, l / 100.0::double AS losses, (g - l) / 100.0::double AS net, e::double AS exempt, greatest((g - l) / 100.0::double - e, 0) AS taxable FROM g"""

_FITS = " AND i.a <= o.a * 1.0005::double AND o.a - i.a <= greatest(o.a * 0.01::double, 1e-8::double) AND o.a - i.a <= o.a * 0.02::double"
_LEGS = SQL["transfer_candidates"].split("SELECT o.asset")[0]
_SCORED = ", c AS (SELECT {key} AS asset, o.asset AS coin, o.at AS out_at, {mark_o} || o.id AS out_id, {mark_i} || i.id AS in_id, abs(o.a - i.a) * 1000000 + abs(i.at - o.at)::double AS score FROM t o JOIN t i ON o.asset = i.asset AND o.dir = 'OUT' AND i.dir = 'IN' AND {on}" + _FITS + ")"
_COIN = " JOIN (SELECT DISTINCT asset, coin FROM c) k ON k.asset = r.asset"
_PAIRED = _GREEDY.replace("SELECT asset, out_id, pick AS in_id", "SELECT coin AS asset, out_id, pick AS in_id").replace("FROM r WHERE pick", f"FROM r{_COIN} WHERE pick")
SQL["on_chain_pairs"] = _recursive(_LEGS) + _SCORED.format(key="o.asset || '/' || (o.seq % 60)", mark_o="''", mark_i="''", on="o.seq % 60 = i.seq % 60") + _PAIRED
SQL["sale_inflows"] = _recursive(more._F) + f", t AS (SELECT *, epoch(timestamp) AS at FROM ledger), c AS (SELECT o.asset, o.at AS out_at, o.id AS out_id, i.id AS in_id, i.at AS score FROM t o JOIN t i ON o.asset = i.asset AND o.transaction_type = 'SELL' AND i.dir = 'IN' AND substr(o.asset, 2)::int % 2 = 1 AND o.amount = i.amount AND o.at - i.at BETWEEN 0 AND 259200 AND {more._AGREE})" + _GREEDY
SQL["unstake_receipts"] = _recursive(more._F) + f", t AS (SELECT *, epoch(timestamp) AS at FROM ledger), b AS (SELECT gid FROM t WHERE transaction_type = 'BUY' AND asset IN ('P0', 'P2')), c AS (SELECT 'P0' AS asset, o.at AS out_at, o.id AS out_id, i.id AS in_id, i.at - o.at AS score FROM t o JOIN t i ON o.transaction_type = 'SELL' AND i.dir = 'IN' AND o.asset IN ('P1', 'P3', 'P5') AND i.asset IN ('P0', 'P2') AND i.at - o.at BETWEEN 0 AND 259200 AND {more._AGREE} WHERE o.gid NOT IN (FROM b))" + _GREEDY
SQL["earn_pairs"] = _recursive(_LEGS) + _SCORED.format(key="o.asset || '/' || o.source", mark_o="'crypto_earn_program_created-'", mark_i="'crypto_earn_program_withdrawn-'", on="o.source = i.source AND i.at - o.at BETWEEN 0 AND 3456000") + _PAIRED
SQL["streamed_pairs"] = SQL["transfer_pairs"]
SQL["retyped_income"] = "WITH" + LEDGER_SQL + """, v AS (SELECT CASE WHEN o % 8 = 3 THEN id || '-crypto_earn_interest_paid' ELSE id END AS id, o, ln, o % 4 = 3 AS app, CASE ln WHEN 2 THEN 'SOL' WHEN 3 THEN 'USDC' ELSE asset END AS asset,
  CASE WHEN ln = 3 THEN 'TRANSFER' WHEN o % 4 = 3 THEN CASE WHEN o % 8 = 3 THEN 'STAKING' ELSE 'AIRDROP' END WHEN o % 2 = 0 THEN CASE ln WHEN 1 THEN 'BUY' ELSE 'SELL' END ELSE CASE ln WHEN 1 THEN 'AIRDROP' ELSE 'FEE' END END AS t,
  CASE WHEN ln = 2 THEN CASE WHEN o % 3 = 0 THEN 0.01 ELSE 1 END ELSE amount END::double AS amount, CASE WHEN ln = 2 THEN CASE o % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 20 END WHEN o % 7 = 0 THEN 0 ELSE fiat END::double AS value
  FROM (SELECT *, seq // 10 AS o, seq % 10 AS ln FROM ledger) WHERE ln <= 3),
c AS (SELECT o, bool_or(app) OR count(*) > 3 AS out, count(*) FILTER (t = 'BUY') AS b, count(*) FILTER (t = 'SELL') AS s, count(*) FILTER (t = 'BUY' AND ln = 1) AS bt, count(*) FILTER (t = 'SELL' AND ln = 2 AND amount <= 0.015 AND value > 0 AND value <= 10) AS small,
  count(*) FILTER (t = 'AIRDROP') AS a, count(*) FILTER (t = 'AIRDROP' AND ln = 1) AS at_, count(*) FILTER (t = 'FEE' AND ln = 2) AS f, count(*) FILTER (t = 'FEE' AND ln = 2 AND (amount > 0.015 OR value > 10)) AS large, max(value) FILTER (ln = 2 AND t = 'FEE') AS paid FROM v GROUP BY o),
g AS (SELECT o, NOT out AND b = 1 AND s = 1 AND bt = 1 AND small = 1 AS claim, NOT out AND a = 1 AND at_ = 1 AND f = 1 AND large = 1 AS trade, paid FROM c)
SELECT id, asset, CASE WHEN claim AND t = 'BUY' THEN 'AIRDROP' WHEN claim AND t = 'SELL' THEN 'FEE' WHEN trade AND t = 'AIRDROP' THEN 'BUY' WHEN trade AND t = 'FEE' THEN 'SELL' ELSE t END AS transaction_type,
  CASE WHEN claim AND t IN ('BUY', 'SELL') THEN NULL ELSE 'X' END AS counter_asset, CASE WHEN trade AND t = 'AIRDROP' AND value <= 0 THEN round(paid, 2) ELSE value END AS value FROM v JOIN g USING (o)"""
#: No group of this view meets a rule: its native legs are large, and fees and airdrops never share an order.
SQL["income_retyped"] = "WITH" + LEDGER_SQL + " SELECT transaction_type, count(*) AS n FROM ledger GROUP BY 1"
