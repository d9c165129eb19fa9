"""Pairs where Spark makes the join of the candidates a broadcast at run time."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinfold.operators import pairing as P
from coinfold.sources.testdata import conform


def test_a_leg_out_has_one_pair_if_the_join_turns_into_a_broadcast(spark):
    """Legs of one moment in 35 groups from 16 tasks; the join is planned by key, and its true size lets it be a broadcast."""
    n = F.col("n")
    x = spark.range(0, 4000, 1, 16).select(F.col("id").alias("n"))
    x = conform(x.select(
        F.concat(F.lit("r"), n.cast("string")).alias("id"), F.timestamp_seconds(n * 0).alias("timestamp"), F.concat(F.lit("A"), (n % 5).cast("string")).alias("asset"), F.lit("TRANSFER").alias("transaction_type"), F.lit(10.0).alias("amount"),
        F.when(n % 2 == 0, "OUT").otherwise("IN").alias("transfer_direction"), F.concat(F.lit("h"), (n % 7).cast("string")).alias("on_chain_tx_id"), F.lit("v").alias("source"), n.alias("seq"),
    ))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = P.on_chain_pairs(x).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    legs = {(i % 5, i % 7): [0, 0] for i in range(4000)}
    for i in range(4000):
        legs[i % 5, i % 7][i % 2] += 1
    assert len({r.out_id for r in rows}) == len(rows) == len({r.in_id for r in rows}) == sum(min(v) for v in legs.values())
