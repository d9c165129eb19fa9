"""Legs paired by one walk, against a plain choice over all pairs."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coinfold.operators import pairing as P
from coinfold.operators import receipts as R
from coinfold.sources.testdata import conform


@pytest.mark.parametrize(("before", "after", "tolerance", "other"), [(50, 50, 1e-6, True), (30, 0, 0.1, False), (0, 40, None, False), (7, 90, 0.6, True)])
def test_walk_takes_what_a_plain_choice_takes(before, after, tolerance, other):
    rng = random.Random(5)
    rows = sorted({(a, float(rng.randint(0, 400)), f"i{n:04d}", float(rng.choice([1, 1.05, 2, 3])), rng.choice(["", "x", "y"]), rng.random() < 0.5) for n in range(900) for a in [rng.choice("AB")]}, key=lambda r: (r[0], r[1], r[2]))
    want, used = [], set()
    for a, t, i, q, m, out in rows:
        fits = [(t2, i2) for a2, t2, i2, q2, m2, o2 in rows if out and not o2 and a2 == a and i2 not in used and -before <= t2 - t <= after
                and (tolerance is None or abs(q - q2) <= max(q, q2) * tolerance) and (m != m2 if other else not m or not m2 or m == m2)]
        if fits:
            used.add(min(fits)[1])
            want.append((a, i, min(fits)[1]))
    df = pd.DataFrame([(a, i, t, q, m, o) for a, t, i, q, m, o in rows], columns=["asset", "id", "at", "amount", "mark", "out"])
    got = pd.concat(P._walk_legs(before, after, tolerance, other)(df.iloc[k : k + 77] for k in range(0, len(df), 77)))
    assert sorted(zip(got.asset, got.out_id, got.in_id, strict=True)) == sorted(want) and len(want) > 50


def test_no_candidates_are_made(spark):
    """2,000 sales and purchases of one moment would be 4,000,000 candidates; only legs move."""
    n = F.col("id")
    x = conform(spark.range(4000).select(
        F.concat(F.lit("r"), n.cast("string")).alias("id"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.lit("A").alias("asset"), F.when(n % 2 == 0, "SELL").otherwise("BUY").alias("transaction_type"),
        F.lit(1.0).alias("amount"), F.concat(F.lit("v"), (n % 3).cast("string")).alias("source"),
    ))
    pairs = P.mistyped_transfers(x)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    rows = pairs.collect()
    assert len(rows) == len({r.in_id for r in rows}) > 1300 and all((int(r.out_id[1:]) - int(r.in_id[1:])) % 3 for r in rows)


def test_unsized_coins_pair_too(spark):
    rows = [("s", "2024-01-01 00:00:00", "MSOL", "SELL", None, "a"), ("i", "2024-01-01 00:00:05", "SOL", "TRANSFER", "IN", None), ("j", "2024-01-01 00:00:01", "SOL", "TRANSFER", "IN", "b")]
    x = conform(spark.createDataFrame(rows, "id string, at string, asset string, transaction_type string, transfer_direction string, on_chain_tx_id string").withColumns({"timestamp": F.col("at").cast("timestamp"), "source": F.lit("solana")}))
    assert [(r.out_id, r.in_id) for r in R.unstake_receipts(x).collect()] == [("s", "i")]
