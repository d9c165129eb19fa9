"""Values of very many tokens of very little, and copies of sales under one group."""

from __future__ import annotations

from datetime import datetime, timedelta

from coinfold.operators import duplicates as D
from coinfold.operators import enrichment as E
from coinfold.sources.testdata import LEDGER

DAY = datetime(2024, 5, 1)


def ledger(spark, rows):
    names = [x.strip().split(" ")[0] for x in LEDGER.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LEDGER)


def test_values_of_meme_coins(spark):
    fees = [("a", 2e12, 3e-7), ("b", 5e6, 3e-7), ("c", 1e15, 1e-9), ("d", 1e15, 1e-18), ("e", 3e-8, 9e8), ("f", 1e25, 1.0), ("g", 5.0, 1e12), ("h", 1.0, None), ("i", 0.0, 1.0)]
    rows = [{"id": i, "timestamp": DAY, "asset": i.upper(), "transaction_type": "FEE", "amount": q} for i, q, _ in fees]
    daily = spark.createDataFrame([(i.upper(), DAY.date(), p) for i, _, p in fees], "asset string, day date, price double")
    got = {r.id: r.fiat_value_at_trigger for r in E.fee_values(ledger(spark, rows), daily).collect()}
    assert got == {"a": 600000.0, "b": 1.5, "c": 1000000.0, "d": None, "e": 27.0, "f": None, "g": None, "h": None, "i": None}
    prices = {r.asset: (r.price, r.price_source) for r in E.resolve_prices(ledger(spark, rows), ("daily", daily.select("asset", "price")), floor=daily.where("asset = 'C'").select("asset", "price")).collect()}
    assert prices["A"] == (3e-7, "daily") and prices["C"] == (1e-9, "daily") and prices["H"] == (None, None)


def test_copies_of_liquid_sales(spark):
    base = {"asset": "MSOL", "source": "solana", "amount": 10.0}
    out, sold = base | {"transaction_type": "TRANSFER", "transfer_direction": "OUT"}, base | {"transaction_type": "SELL"}
    late = DAY + timedelta(days=3)
    rows = [
        sold | {"id": "s1", "timestamp": DAY, "trade_group_id": "g", "on_chain_tx_id": "x" * 40}, out | {"id": "same group, other id", "timestamp": late, "trade_group_id": "g", "on_chain_tx_id": "y" * 40, "amount": 9.9},
        out | {"id": "same signature", "timestamp": late, "on_chain_tx_id": "x" * 40}, out | {"id": "within the hour", "timestamp": DAY + timedelta(minutes=50), "amount": 10.1}, out | {"id": "another group", "timestamp": late, "trade_group_id": "h"},
        out | {"id": "another size", "timestamp": late, "trade_group_id": "g", "amount": 5.0}, sold | {"id": "s2", "timestamp": DAY, "trade_group_id": "short-mark-1"}, out | {"id": "group begins alike", "timestamp": late, "trade_group_id": "short-mark-2"}, out | {"id": "no marks", "timestamp": late},
    ]
    got = {r.id for r in D.liquid_sales(ledger(spark, rows)).collect()}
    assert got == {"same group, other id", "same signature", "within the hour"}
