"""The ledger is dealt by asset and not by day, whatever Spark takes the rates to be large as, and sorted once for both kinds of match."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinfold.plans import us_lots as US
from coinfold.sources.testdata import ledger_from_tpch, rates_from_tpch

SF = "/root/testdata/sf0.001"
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_rates_dont_deal_the_ledger(spark):
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "1")  # as at scale, where the rates' estimate is that of the table they are made of
    try:
        text = _final(US.matches(ledger_from_tpch(spark, SF), "FIFO", "USD", rates_from_tpch(spark, SF, "USD")))
    finally:
        spark.conf.set(THRESHOLD, before)
    assert "fx_day" in text and "SortMergeJoin" not in text and "hashpartitioning(fx_day" not in text


def test_events_are_sorted_twice_only(spark):
    """In order of time and along the axis; each sort held all rows of a task, and there were four."""
    text = _final(US.fifo_matches(US.lot_events(ledger_from_tpch(spark, SF), "USD")))
    assert text.count("Sort [") == 2


def test_disposals_without_lots_take_no_axis(spark):
    """Bare, half covered and covered disposals of one asset, and one of an asset without lots."""
    rows = [("d0", "A", 1, -1, 300), ("l1", "A", 2, 1, 500), ("d1", "A", 3, -1, 200), ("d2", "A", 4, -1, 700), ("d3", "A", 5, -1, 400), ("l2", "A", 6, 1, 1000), ("d4", "A", 7, -1, 350), ("e0", "B", 1, -1, 900)]
    e = spark.createDataFrame(rows, "id string, asset string, t long, sign int, n long").select("id", "asset", F.timestamp_seconds("t").alias("timestamp"), F.lit("").alias("gid"), "sign", *[(F.col("n") * k).cast("decimal(38,0)").alias(c) for k, c in ((1, "qty_u"), (2, "value_c"))])
    want = {("d0", None, 300), ("d1", "l1", 200), ("d2", "l1", 300), ("d2", None, 400), ("d3", None, 400), ("e0", None, 900), ("d4", "l2", 350)}
    for n in (0, 10**9):
        m = US.fifo_matches(e, hot_legs=n).collect()
        assert {(r.disposal_id, r.lot_id, int(r.qty_u)) for r in m} == want and len(m) == len(want)
        assert all(r.proceeds_c == 2 * r.qty_u and r.cost_c == (2 * r.qty_u if r.lot_id else 0) for r in m)
        assert [(r.id, int(r.qty_u)) for r in US.fifo_open_lots(e, hot_legs=n).collect()] == [("l2", 650)]


def test_harvest_gathers_no_losses(spark):
    """Losses are ranked in ranges: only the totals of the ranges meet in one task."""
    pos = spark.createDataFrame([(f"P{i}", -float(i % 900)) for i in range(2000)], "asset string, unrealized double")
    h = US.harvest_uk(pos, band=100_000.0)
    rows, left = sorted(h.collect(), key=lambda r: (-r.loss, r.asset)), 100_000.0
    assert len(rows) == 1997
    for r in rows:
        assert r.at_basic == min(r.loss, left) and abs(r.tax_saved - 0.18 * r.at_basic - 0.24 * (r.loss - r.at_basic)) < 0.006
        left -= r.at_basic
    assert "_w0" not in (text := _final(h)) and text.count("Window [") == 2 and "__part" in text
