"""FIFO by whole assets and by slices give the same matches, and cold assets are dealt once."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinfold.plans import us_lots as US
from coinfold.sources.testdata import ledger_from_tpch

SF = "/root/testdata/sf0.001"


def _events(spark):
    x = ledger_from_tpch(spark, SF).withColumn("asset", F.concat(F.lit("P"), (F.pmod(F.substring("asset", 2, 9).cast("int"), F.lit(30)) % 17).cast("string")))
    return US.lot_events(x, "USD")


def test_slices_and_whole_assets_agree(spark):
    e = _events(spark)
    rows = [sorted(map(str, US.fifo_matches(e, hot_legs=n).collect())) for n in (0, 250, 10**9)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 1000


def test_cold_assets_are_dealt_once(spark):
    """Besides the small count of legs by asset, one dealing of the rows serves all windows and both kinds of match."""
    m = US.fifo_matches(_events(spark))
    plan = m._jdf.queryExecution().sparkPlan().toString()
    m.collect()
    text = m._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Join") == 0 and text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 2
