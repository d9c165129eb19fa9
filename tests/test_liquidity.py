"""Open pool shares and inferred sales against a walk over lots, and funding rows."""

from __future__ import annotations

import random

import pytest

from coinfold.operators import classifiers as C
from coinfold.operators.liquidity import inferred_burns, open_shares
from coinfold.sources import exports as X

from tests.test_classifiers import g
from tests.test_ledger import ledger


def share(day, kind, amount, asset, gid=None):
    return (day, kind, amount, 0, g(asset, gid, event_subtype="lp_add" if kind == "BUY" else "lp_remove"))


def walk(lots, sales, removes):
    """lots: (day, id, asset, amount); sales: asset -> amount; removes: (day, gid). What each remove closes, lot by lot."""
    rest = []
    for day, i, asset, amount in sorted(lots):
        take = min(amount, sales.get(asset, 0))
        sales[asset] = sales.get(asset, 0) - take
        if amount > take:
            rest.append((day, i, asset, amount - take))
    out = {}
    for day, gid in sorted(removes):
        if rest:
            pick = next((x for x in rest if x[0] <= day), rest[0])
            out[f"lp-dispose-{gid}"] = (pick[2], pick[3], len(rest) > 1)
            rest.remove(pick)
    return out


@pytest.mark.parametrize("seed,n_lots,n_removes", [(1, 9, 5), (2, 4, 7), (3, 0, 2), (4, 6, 0)])
def test_inferred_burns_against_a_walk(spark, seed, n_lots, n_removes):
    rnd = random.Random(seed)
    day = lambda: f"2024-01-{rnd.randint(1, 9):02d}"
    rows, lots, sales, removes = [], [], {}, []
    for _ in range(n_lots):
        d, a, q = day(), rnd.choice(["LP:A", "LP:B", "LP:C"]), rnd.randint(1, 4)
        lots.append((d, f"t{len(rows):02d}", a, q))
        rows.append(share(d, "BUY", q, a))
    for a, q in (("LP:A", 3), ("LP:B", 1), ("LP:Z", 2)):
        sales[a] = q
        rows.append(share("2024-01-05", "SELL", q, a, f"burned-{a}"))
    for i in range(n_removes):
        d = day()
        removes.append((d, f"r{i}"))
        rows += [(d, "BUY", 1, 10.25, g("SOL", f"r{i}", event_subtype="lp_remove")), (d, "BUY", 2, 5, g("ABC", f"r{i}", event_subtype="lp_remove"))]
    x = ledger(spark, rows)
    y = inferred_burns(x)
    new = {r.id: r for r in y.where("id like 'lp-dispose-%'").collect()}
    want = walk(lots, sales, removes)
    assert {i: (r.asset, r.amount, "verify" in r.normalization_note) for i, r in new.items()} == want
    assert all((r.transaction_type, r.event_subtype, r.fiat_value_at_trigger) == ("SELL", "lp_remove", 15.25) for r in new.values())
    assert y.count() == len(rows) + len(want)


def test_inferred_burns_follow_liquidity_for_tax(spark):
    t = lambda asset, gid, way: g(asset, gid, transfer_direction=way)
    x = ledger(spark, [("2024-01-01", "TRANSFER", 1, 145, t("SOL", "a", "OUT")), ("2024-01-01", "TRANSFER", 9, 150, t("ABC", "a", "OUT")), ("2024-01-02", "TRANSFER", 1, 100, t("SOL", "r", "IN")), ("2024-01-02", "TRANSFER", 9, 50, t("ABC", "r", "IN"))])
    y = inferred_burns(C.liquidity_for_tax(x))
    n = y.where("id = 'lp-dispose-r'").first()
    assert (n.asset, n.amount, n.fiat_value_at_trigger) == ("LP:A", 1.0, 150.0) and "verify" not in n.normalization_note
    assert open_shares(y).count() == 0 and inferred_burns(y).count() == y.count()


def test_drift_funding(spark):
    rows = [("s1", 3, 1, "-2500000", "1700000000"), ("s1", 3, 1, "-2500000", "1700000000"), ("", None, 7, "40", "1700000001"), ("s2", 0, 1, "0", "1700000002"), ("s3", 0, 1, "5", None), ("s4", 0, None, "x", "1700000003")]
    p = spark.createDataFrame(rows, "txSig string, txSigIndex int, marketIndex int, fundingPayment string, ts string")
    m = spark.createDataFrame([(1, "sol-perp"), (2, "")], "marketIndex int, symbol string")
    got = {r.id: (r.asset, r.transaction_type, r.fee_fiat, r.realized_pnl) for r in X.parse_drift_funding(p, m).collect()}
    assert got == {"drift-funding-s1-3": ("SOL", "FEE", 2.5, -2.5), "drift-funding-1700000001-7": ("MARKET-7", "FEE", 0.00004, 0.00004)}
    assert {r.asset for r in X.parse_drift_funding(p).collect()} == {"MARKET-1", "MARKET-7"}
