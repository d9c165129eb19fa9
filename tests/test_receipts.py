"""Liquid staking across rows, streamed greedy pairing and pool details, against small cases and a walk."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coinfold.operators.pairing import assigned
from coinfold.operators.receipts import liquid_staking, native_legs, sale_inflows, unstake_receipts
from coinfold.plans import uk_cgt as UK
from coinfold.sources.testdata import LEDGER, conform

START = datetime(2024, 3, 1, 12)


def rows(spark, *legs):
    """legs: (id, seconds, asset, type, amount, value, more)."""
    names = [c.strip().split(" ")[0] for c in LEDGER.split(",")]
    out = []
    for n, (i, s, asset, kind, amount, value, more) in enumerate(legs):
        x = dict.fromkeys(names) | {"id": i, "timestamp": START + timedelta(seconds=s), "asset": asset, "transaction_type": kind, "amount": float(amount), "fiat_value_at_trigger": float(value), "source": "solana", "seq": n} | more
        out.append(tuple(x[c] for c in names))
    return conform(spark.createDataFrame(out, LEDGER))


IN, OUT = {"transfer_direction": "IN"}, {"transfer_direction": "OUT"}


def walk(candidates, *keys):
    used, taken, out = {}, set(), set()
    for c in sorted(candidates, key=lambda c: (c["out_at"], c["out_id"], c["score"], c["in_id"])):
        k = tuple(c[x] for x in keys)
        if (k, c["out_at"], c["out_id"]) not in taken and c["in_id"] not in used.setdefault(k, set()):
            taken.add((k, c["out_at"], c["out_id"]))
            used[k].add(c["in_id"])
            out.add((c["out_id"], c["in_id"]))
    return out


@pytest.mark.parametrize("seconds", [None, 20])
def test_assigned_against_a_walk(spark, seconds):
    """One asset with most candidates, ties of scores and times, and batches that end within a leg."""
    rnd = random.Random(4)
    at = {f"i{n}": rnd.randrange(300) for n in range(400)}
    c = []
    for n in range(500):
        asset, when = ("HOT" if n % 5 else f"A{n % 7}"), rnd.randrange(300)
        for i in rnd.sample(sorted(at), 25):
            if abs(at[i] - when) <= 20:
                c.append({"asset": asset, "out_id": f"o{n}", "in_id": i, "out_at": float(when), "in_at": float(at[i]), "score": float(rnd.randrange(4))})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(c, "asset string, out_id string, in_id string, out_at double, in_at double, score double")
        got = assigned(df, "asset", seconds=seconds).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.out_id, r.in_id) for r in got) == sorted(walk(c, "asset"))
    assert assigned(df.where(F.lit(False)), "asset", seconds=seconds).count() == 0


def test_an_inflow_before_a_sale_is_used_once(spark):
    x = rows(
        spark, ("in1", 0, "msol ", "TRANSFER", 10, 0, IN), ("in2", 60, "MSOL", "TRANSFER", 10.04, 0, IN | {"on_chain_tx_id": "t2"}), ("late", 9000, "MSOL", "TRANSFER", 10, 0, IN), ("s1", 600, "MSOL", "SELL", 10, 900, {"on_chain_tx_id": "t1"}),
        ("s2", 700, "MSOL", "SELL", 10, 800, {"on_chain_tx_id": "t2"}), ("s3", 800, "MSOL", "SELL", 10, 700, {}), ("other", 500, "BSOL", "TRANSFER", 10, 0, IN), ("null", 500, None, "TRANSFER", 10, 0, IN),
    )
    assert {(r.out_id, r.in_id) for r in sale_inflows(x).collect()} == {("s1", "in1"), ("s2", "in2")}


def test_coins_after_a_sale(spark):
    x = rows(
        spark, ("s1", 0, "MSOL", "SELL", 10, 900, {"trade_group_id": "g1"}), ("b1", 0, "SOL", "BUY", 11, 900, {"trade_group_id": "g1"}), ("s2", 10, "JITOSOL", "SELL", 5, 450, {"trade_group_id": "g2"}), ("s3", 20, "MSOL", "SELL", 1, 90, {}),
        ("early", 5, "SOL", "TRANSFER", 5, 0, IN), ("c2", 30, "SOL", "TRANSFER", 5.5, 0, IN), ("c3", 40, "WSOL", "TRANSFER", 1.1, 0, IN), ("far", 921, "SOL", "TRANSFER", 1.1, 0, IN),
    )
    assert {(r.out_id, r.in_id) for r in unstake_receipts(x).collect()} == {("s2", "c2"), ("s3", "c3")}


def test_native_sales_beside_a_receipt(spark):
    x = rows(
        spark, ("r", 0, "MSOL", "SELL", 10, 900, {"trade_group_id": "g"}), ("fee", 0, "SOL", "SELL", 0.01, 1, {"trade_group_id": "g"}), ("turned", 1, "SOL", "SELL", 11, 890, {"trade_group_id": "g"}), ("kept", 2, "SOL", "SELL", 2, 160, {"trade_group_id": "g"}),
        ("alone", 0, "SOL", "SELL", 0.01, 1, {"trade_group_id": "h"}),
    )
    got = {r.id: (r.transaction_type, r.counter_asset) for r in native_legs(x).collect()}
    assert got == {"r": ("SELL", None), "fee": ("FEE", None), "turned": ("BUY", "MSOL"), "kept": ("SELL", None), "alone": ("SELL", None)}


def test_liquid_staking_in_order(spark):
    x = rows(
        spark, ("copy", 0, "MSOL", "TRANSFER", 10, 0, OUT), ("in", -600, "MSOL", "TRANSFER", 10, 0, IN), ("s", 0, "MSOL", "SELL", 10, 900, {"trade_group_id": "g"}), ("coin", 100, "SOL", "TRANSFER", 11, 0, IN), ("echo", 120, "SOL", "TRANSFER", 11, 0, OUT),
        ("own", 4000, "SOL", "TRANSFER", 11, 0, OUT),
    )
    got = {r.id: r for r in liquid_staking(x).collect()}
    assert sorted(got) == ["coin", "in", "own", "s"]
    assert (got["in"].transaction_type, got["in"].fiat_value_at_trigger, got["in"].counter_asset, got["in"].trade_group_id, got["in"].fiat_currency) == ("BUY", 900.0, "SOL", "g", "USD")
    assert (got["coin"].transaction_type, got["coin"].fiat_value_at_trigger, got["coin"].counter_asset, got["coin"].trade_group_id, got["coin"].transfer_direction) == ("BUY", 900.0, "MSOL", "g", None)
    assert liquid_staking(x.where(F.lit(False))).count() == 0


def test_pool_details_name_the_first_day_in_the_pool(spark):
    day = 86400
    x = rows(
        spark, ("b0", 0, "X", "BUY", 5, 50, {}), ("d0", 60, "X", "SELL", 5, 60, {}), ("b1", 40 * day, "X", "BUY", 4, 40, {}), ("b2", 50 * day, "X", "BUY", 4, 44, {}), ("d1", 90 * day, "X", "SELL", 2, 30, {}), ("b3", 0, "Y", "BUY", 1, 9, {}),
    )
    got = {r.asset: (r.quantity, r.earliest_acquisition) for r in UK.pool_details(UK.uk_engine(UK.uk_legs(x))).collect()}
    assert got == {"X": (6.0, date(2024, 4, 10)), "Y": (1.0, date(2024, 3, 1))}
