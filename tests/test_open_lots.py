"""Open lots come from the one dealing of the events that makes the matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinfold import queries as Q
from coinfold.plans import us_lots as US
from coinfold.sources.testdata import ledger_from_tpch

SF = "/root/testdata/sf0.001"


def test_lots_are_those_of_the_matches(spark):
    x = ledger_from_tpch(spark, SF).withColumn("asset", F.concat(F.lit("P"), (F.pmod(F.substring("asset", 2, 9).cast("int"), F.lit(30)) % 17).cast("string")))
    bare = F.pmod("seq", F.lit(50))
    e = US.lot_events(x.withColumns({"asset": F.when(bare != 1, F.col("asset")), "timestamp": F.when(bare != 2, F.col("timestamp"))}), "USD")
    want = sorted(map(str, US.open_lots(e, US.fifo_matches(e)).collect()))
    for n in (0, 250, 10**9):
        assert sorted(map(str, US.fifo_open_lots(e, hot_legs=n).collect())) == want and len(want) > 100


def test_events_are_dealt_once(spark):
    """No join of lots with their matches by id, and no dealing by lot beside that by asset."""
    lots = Q._lots(spark, SF)
    lots.collect()
    text = lots._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "lot_id" not in text and "SortMergeJoin" not in text and text.count("Exchange hashpartitioning(asset") - text.count("ReusedExchange") <= 2
