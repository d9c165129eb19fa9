"""Pairs chosen among legs against a plain walk over all candidates."""

from __future__ import annotations

import random

import pytest

from coinfold.operators import pairing as P

LEG = "asset string, key string, id string, at double, amount double, mark string, out boolean"


def walk(rows, before, after, other):
    """Every leg out meets every leg in."""
    pairs = []
    for group in sorted({r[:2] for r in rows}, key=str):
        mine, used = [r for r in rows if r[:2] == group], set()
        for o in sorted((r for r in mine if r[6]), key=lambda r: (r[3], r[2])):
            c = []
            for i in mine:
                fee, apart = o[4] - i[4], i[3] - o[3]
                near = -before <= apart <= after and i[4] <= o[4] * 1.0005 and fee <= max(o[4] * 0.01, 1e-8) and fee <= o[4] * 0.02
                if not i[6] and near and not (other and o[5] is not None and o[5] == i[5]) and i[2] not in used:
                    c.append((abs(fee) * 1e6 + abs(apart), i[2]))
            if c:
                used.add(min(c)[1])
                pairs.append((group[0], o[2], min(c)[1]))
    return sorted(pairs)


@pytest.mark.parametrize("before, after, other", [(float("inf"), float("inf"), False), (0, 900, False), (300, 300, True)])
def test_nearest_against_a_walk(spark, before, after, other):
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        amount = rnd.choice([1.0, 1.0, 0.995, 0.9999, 2.0, 1.9999, 0.0001, 0.0000995, 1e13, 1e13 - 5e9])
        rows.append((rnd.choice("AB"), rnd.choice(["g", "h", None]), f"l{rnd.randrange(10**6):06d}{i}", float(rnd.randrange(6000)) + rnd.choice([0, 0.25]), amount, rnd.choice(["x", "y", None]), rnd.random() < 0.5))
    df = spark.createDataFrame(rows, LEG).repartition(7)
    got = sorted((r.asset, r.out_id, r.in_id) for r in P.nearest(df, "key", before=before, after=after, other=other).collect())
    want = walk(rows, before, after, other)
    assert got == want and len(want) > 100
    assert P.nearest(df.where("false"), "key").count() == 0


def test_pairs_of_one_group_make_no_candidates(spark):
    """40,000 legs of one group and amount: 4e8 candidates before, which the plan doesn't make any more."""
    n = spark.range(40_000).selectExpr("id as n")
    x = n.selectExpr("'A' as asset", "cast(n as string) as id", "timestamp_seconds(n * 60) as timestamp", "'TRANSFER' as transaction_type", "cast(null as string) as transfer_pair_id", "2.0D as amount", "'v' as source", "if(n % 2 = 0, 'OUT', 'IN') as transfer_direction", "'h' as on_chain_tx_id", "cast(null as string) as trade_group_id")
    pairs = P.on_chain_pairs(x)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 20_000


def test_a_line_forgets_what_is_old_and_finds_its_way():
    line = P._Line()
    for t in range(5000):
        line.put(float(t), f"a{t:05d}")
    for t in range(2000, 2900):
        line.pop(t)
    line.forget(4100.0, 1500.0)  # over half of it goes, and places move
    assert line.left == 5000 - 2900 and line.around(2600.0, 500, 500, 0.0, set())[:2] == (300.0, "a02900")
    assert line.around(2600.0, 500, 200, 0.0, set()) is None
