"""A cut computes its rows once."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinfold.functions.lineage import cut


def test_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    x = cut(spark.range(100).repartition(3).mapInPandas(count, "id long"))
    assert x.agg(F.sum("id")).first()[0] == 4950 and seen.value == 100
