"""Queries that run a stream to its end over the view, and the import of a batch; with the SQL that DuckDB checks them with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import checkpoint_dir
from .operators import app_legs as A
from .operators import classifiers as C
from .operators import ledger_ops as L
from .operators import views as W
from .plans import ledger_store as T
from .plans import uk_cgt as UK
from .sources.testdata import LEDGER_SQL, ledger_from_tpch, rates_from_tpch
from .streaming import uk_stream as U


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/coinfold-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = UK.uk_legs(ledger_from_tpch(spark, sf_dir), rates_from_tpch(spark, sf_dir, "GBP"))
    rows = U.replayed(spark, legs, folder(spark)).where("is_final")
    money = lambda c: F.round(c, 2).cast("double").alias(c)
    return rows.select("asset", "match_type", "day", "disposal_id", "acquisition_id", F.round("quantity", 8).cast("double").alias("quantity"), money("proceeds"), money("cost"))


def import_view(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The view as a stored ledger (two thirds of the rows) and a batch: the other third, and of the stored rows copies with their id,
    with another id, and with another id, time and value under one on-chain id."""
    seq, k = F.col("seq"), F.pmod(F.col("seq"), F.lit(30))
    x = x.withColumns({
        "source": F.when(F.pmod(seq, F.lit(4)) == 0, "binance").otherwise(F.col("source")), "on_chain_tx_id": F.when(F.pmod(seq, F.lit(5)) == 3, F.concat(F.lit("c"), seq.cast("string"))), "instrument_kind": F.lit(None).cast("string"),
        "asset": F.when(F.pmod(seq, F.lit(13)) == 0, "www.claim.com").otherwise(F.col("asset")), "fiat_value_at_trigger": F.when(F.pmod(seq, F.lit(11)) == 0, 0.3).otherwise(F.col("fiat_value_at_trigger")),
    })
    stored, fresh = x.where(F.pmod(seq, F.lit(3)) > 0), x.where(F.pmod(seq, F.lit(3)) == 0)
    other = F.concat(F.lit("again-"), "id")
    copies = stored.where(k.isin(1, 2, 8, 13)).withColumns({
        "id": F.when(k == 1, F.col("id")).otherwise(other), "fiat_value_at_trigger": F.when(k.isin(8, 13), F.col("fiat_value_at_trigger") + 1).otherwise(F.col("fiat_value_at_trigger")),
        "timestamp": F.when(k.isin(8, 13), F.col("timestamp") + F.expr("interval 1 minute")).otherwise(F.col("timestamp")),
    })
    twice = fresh.where(k.isin(0, 15)).withColumn("id", other)
    return stored, fresh.unionByName(copies).unionByName(twice)


REWRITES = [W.with_on_chain_ids, C.timezone_copies, lambda x: x.where(~L.is_spam(F.col("asset"))), lambda x: x.where(~L.is_dust())]


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    present, batch = import_view(ledger_from_tpch(spark, sf_dir))
    store = T.LedgerStore(spark, folder(spark))
    store.commit(present, store.imports(), None)
    T.import_batch(store, batch, "batch", REWRITES, label="batch.csv")
    T.import_batch(store, batch, "again", REWRITES, label="batch.csv")  # changes nothing
    return store.read().select("id", "timestamp", "asset", "transaction_type", "amount", "fiat_value_at_trigger", "source", "import_id", "on_chain_tx_id")


def swap_view(x: DataFrame) -> DataFrame:
    """The view as an app's swaps and other purchases: two orders a minute, every third order of another venue, counter legs now and then."""
    seq = F.col("seq")
    o, ln, n = F.floor(seq / 10), F.pmod(seq, F.lit(10)), F.pmod(F.substring("asset", 2, 9).cast("int"), F.lit(40))
    app, c = F.pmod(o, F.lit(3)) < 2, F.pmod(n + 1 + ln % 2, F.lit(41))
    return x.withColumns({
        "asset": F.concat(F.lit("P"), n.cast("string")), "amount": F.pmod("amount", F.lit(5)) + 1, "timestamp": F.timestamp_seconds(946684800 + F.floor(o / 2) * 60), "source": F.when(app, "cryptocom").otherwise("kraken"), "id": F.when(app, F.concat(F.lit("cdc-"), "id", F.lit("-crypto_exchange-"), ln.cast("string"))).otherwise(F.col("id")),
        "transaction_type": F.when(ln % 2 == 1, "BUY").otherwise("SELL"), "counter_asset": F.when(app & (ln % 3 > 0), F.when(c == 40, "USDT").otherwise(F.concat(F.lit("P"), c.cast("string")))), "counter_amount": F.when(seq % 5 == 0, F.pmod("amount", F.lit(5)) + 3),
        "fiat_value_at_trigger": F.when(seq % 7 == 0, 0.0).otherwise(F.col("fiat_value_at_trigger")), "trade_group_id": F.when(o % 2 == 0, F.col("trade_group_id")),
    })


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missing_legs(swap_view(ledger_from_tpch(spark, sf_dir))).select("id", "timestamp", "asset", "transaction_type", "amount", "fiat_value_at_trigger", "counter_asset", "counter_amount", "trade_group_id")


QUERIES = {"streamed_matches": _streamed, "imported_ledger": _imported, "missing_legs": _legs}

_CHAIN = "md5(concat_ws('|', on_chain, transaction_type, asset, amount, dir))"
_CONTENT = "md5(concat_ws('|', source, coalesce(on_chain, gid), transaction_type, asset, amount, dir, round(fiat, 2), epoch_us(timestamp)))"
_BEST = "(CASE WHEN on_chain IS NULL THEN 1 ELSE 0 END, -fiat, timestamp, seq, id)"


def _distinct(name: str, of: str) -> str:
    """The three stages: an id, a content, an on-chain leg has one row."""
    one = lambda k: f"QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {_BEST}) = 1"
    return f"{name}1 AS (SELECT * FROM {of} {one('id')}), {name}2 AS (SELECT * FROM {name}1 {one(_CONTENT)}), {name} AS (SELECT * FROM {name}2 {one(f'CASE WHEN on_chain IS NULL THEN id ELSE {_CHAIN} END')})"


def _pass(name: str, of: str) -> str:
    """One pass of the rewrites."""
    key = "source, asset, transaction_type, amount, fiat, dir"
    return f"""{name}a AS (SELECT *, CASE WHEN source IN ('binance', 'exchange') AND epoch(timestamp) - epoch(lag(timestamp) OVER w) BETWEEN 3500 AND 3700 THEN 0 ELSE 1 END AS head FROM {of} WINDOW w AS (PARTITION BY {key} ORDER BY timestamp, seq, id)),
  {name}b AS (SELECT *, sum(head) OVER (PARTITION BY {key} ORDER BY timestamp, seq, id ROWS UNBOUNDED PRECEDING) AS run FROM {name}a),
  {name} AS (SELECT * EXCLUDE (head, run) FROM {name}b WHERE asset <> 'www.claim.com' AND NOT (fiat > 0 AND fiat < 0.5) QUALIFY row_number() OVER (PARTITION BY {key}, run ORDER BY timestamp, seq, id) % 2 = 1)"""


_MADE = """SELECT 'cdc-' || strftime(tm, '%Y-%m-%dT%H:%M:%S+00:00') || '-crypto_exchange-{low}-' || counter AS id, tm, counter AS asset, '{lack}' AS k, arg_min(ca, (seq, id)) AS amount, arg_min(fiat, (seq, id)) AS fiat, arg_min(asset, (seq, id)) AS c, arg_min(amount, (seq, id)) AS ca,
    'cdc-xchg-' || strftime(tm, '%Y-%m-%dT%H:%M:%S+00:00') AS gid
  FROM (SELECT * FROM g WHERE app AND k = '{have}' AND counter <> 'USDT' AND ca > 0 QUALIFY row_number() OVER (PARTITION BY tm, asset ORDER BY seq, id) = 1) a
  WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.app AND b.k = '{lack}' AND b.tm = a.tm AND b.asset = a.counter) GROUP BY tm, counter"""
SQL = {
    "missing_legs": f"""WITH {LEDGER_SQL},
a AS (SELECT CASE WHEN app THEN 'cdc-' || id || '-crypto_exchange-' || ln ELSE id END AS id, seq, app, tm, 'P' || n AS asset, CASE WHEN ln % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS k, amount % 5 + 1 AS amount, CASE WHEN seq % 7 = 0 THEN 0 ELSE fiat END AS fiat,
    CASE WHEN app AND ln % 3 > 0 THEN CASE WHEN c = 40 THEN 'USDT' ELSE 'P' || c END END AS counter, CASE WHEN seq % 5 = 0 THEN amount % 5 + 3 END AS ca, CASE WHEN o % 2 = 0 THEN gid END AS gid
  FROM (SELECT *, o % 3 < 2 AS app, (n + 1 + ln % 2) % 41 AS c, make_timestamp((946684800 + (o // 2) * 60) * 1000000) AS tm FROM (SELECT *, seq // 10 AS o, seq % 10 AS ln, substr(asset, 2)::int % 40 AS n FROM ledger))),
peer AS (SELECT tm, asset, arg_min(amount, (seq, id)) AS amount FROM a WHERE app GROUP BY tm, asset),
told AS (SELECT asset, tm, arg_max(fiat / amount, (seq, id)) AS last, arg_min(fiat / amount, (seq, id)) AS first FROM a WHERE k = 'BUY' AND fiat > 0 GROUP BY asset, tm),
e AS (SELECT a.*, t.last AS unit FROM a ASOF LEFT JOIN told t ON t.asset = a.counter AND t.tm <= a.tm),
l AS (SELECT e.*, t.tm AS later, t.first AS next FROM e ASOF LEFT JOIN told t ON t.asset = e.counter AND t.tm > e.tm),
g AS (SELECT l.* REPLACE (CASE WHEN app AND counter IS NOT NULL AND ca IS NULL THEN coalesce(round(coalesce(CASE WHEN l.asset <> counter THEN p.amount END, CASE WHEN fiat > 0 THEN fiat / coalesce(unit, CASE WHEN epoch(later) - epoch(l.tm) <= 600 THEN next END) END), 8), ca) ELSE ca END AS ca)
  FROM l LEFT JOIN peer p ON p.tm = l.tm AND p.asset = counter),
made AS ({_MADE.format(have="BUY", lack="SELL", low="sell")} UNION ALL {_MADE.format(have="SELL", lack="BUY", low="buy")})
SELECT g.id, g.tm AS timestamp, g.asset, k AS transaction_type, g.amount, g.fiat AS fiat_value_at_trigger, counter AS counter_asset, g.ca AS counter_amount, coalesce(g.gid, m.gid) AS trade_group_id
FROM g LEFT JOIN (SELECT DISTINCT tm, c, gid FROM made) m ON m.tm = g.tm AND m.c = g.asset
UNION ALL SELECT id, tm, asset, k, amount, fiat, c, ca, gid FROM made""",
    "imported_ledger": f"""WITH {LEDGER_SQL},
v AS (SELECT id, timestamp, CASE WHEN seq % 13 = 0 THEN 'www.claim.com' ELSE asset END AS asset, transaction_type, amount, CASE WHEN seq % 11 = 0 THEN 0.3 ELSE fiat END AS fiat, CASE WHEN seq % 4 = 0 THEN 'binance' ELSE source END AS source, import_id, dir, gid, seq,
  CASE WHEN seq % 5 = 3 THEN 'c' || seq END AS on_chain FROM ledger),
kept AS (SELECT * FROM v WHERE seq % 3 > 0),
sent AS (SELECT * FROM v WHERE seq % 3 = 0
  UNION ALL SELECT * REPLACE (CASE WHEN seq % 30 = 1 THEN id ELSE 'again-' || id END AS id, CASE WHEN seq % 30 IN (8, 13) THEN fiat + 1 ELSE fiat END AS fiat, CASE WHEN seq % 30 IN (8, 13) THEN timestamp + INTERVAL 1 MINUTE ELSE timestamp END AS timestamp) FROM kept WHERE seq % 30 IN (1, 2, 8, 13)
  UNION ALL SELECT * REPLACE ('again-' || id AS id) FROM v WHERE seq % 30 IN (0, 15)),
tagged AS (SELECT * REPLACE ('batch' AS import_id) FROM sent), {_distinct("b", "tagged")},
{_distinct("h", "kept")}, have AS (SELECT * FROM h WHERE NOT (fiat > 0 AND fiat < 0.5)),
novel AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM have) AND {_CONTENT} NOT IN (SELECT {_CONTENT} FROM have) AND (on_chain IS NULL OR {_CHAIN} NOT IN (SELECT {_CHAIN} FROM have WHERE on_chain IS NOT NULL))),
merged AS (SELECT * FROM have UNION ALL SELECT * FROM novel), {_pass("p", "merged")}, {_pass("q", "p")}, {_distinct("d", "q")}
SELECT id, timestamp, asset, transaction_type, amount, fiat AS fiat_value_at_trigger, source, import_id, on_chain AS on_chain_tx_id FROM d""",
}
