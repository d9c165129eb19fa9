"""What the dedup of an import deals."""

from __future__ import annotations

from coinfold.operators import identity as I
from coinfold.sources.testdata import conform


def test_rows_without_a_copy_are_not_dealt(spark, tmp_path):
    """Of 3,000 rows ten have a copy under another id; only those meet in an aggregation."""
    n = spark.range(3000).selectExpr("id as n")
    x = conform(n.selectExpr("cast(n as string) as id", "timestamp_seconds(n) as timestamp", "'A' as asset", "'BUY' as transaction_type", "1.0D as amount", "'v' as source", "n as seq"))
    x.unionByName(x.where("seq < 10").selectExpr("concat('b', id) as id", *[f"`{c}`" for c in x.columns if c != "id"]).select(*x.columns)).write.parquet(f"{tmp_path}/x")
    out = I.deduplicated(spark.read.parquet(f"{tmp_path}/x"))
    assert out.count() == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan  # the others pass beside the aggregations
    clean = I.deduplicated(x)
    assert "Aggregate" not in clean._jdf.queryExecution().optimizedPlan().toString() and clean.count() == 3000
