"""The ledger's dedup deals rows once for each of its keys."""

from pyspark.sql import functions as F

from coinfold.operators import ledger_ops as L
from coinfold.sources.testdata import ledger_from_tpch


def test_rows_are_dealt_once_by_content(spark):
    x = ledger_from_tpch(spark, "/root/testdata/sf0.001").withColumn("on_chain_tx_id", F.when(F.col("seq") % 2 == 0, F.col("trade_group_id")))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = L.dedup(x).select("id", "asset", "seq")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    dealt = [line.lstrip(" :+-") for line in plan.splitlines() if "Exchange" in line]
    assert [line.split()[0] for line in dealt] == ["Exchange", "Exchange", "Exchange", "ReusedExchange"]
