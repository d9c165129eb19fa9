from __future__ import annotations

from coinfold.operators import venue_repairs as V

from tests.test_ledger import ledger

K = {"source": "kraken"}


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_venue_repairs(spark):
    rows = [
        ("2024-01-01", "FEE", 0.01, 0, {**K, "trade_group_id": "r1", "fee_fiat": 300.0}),
        ("2024-01-02", "SELL", 0.002, 0, K),
        ("2024-01-03", "BUY", 0.003, 90, K),
        ("2024-01-04", "SELL", 0.002, 0, K),
        ("2024-01-05", "SELL", 2, 100, {**K, "asset": "ADA", "trade_group_id": "r2"}),
        ("2024-01-05", "TRANSFER", 1, 0, {**K, "asset": "DOT", "trade_group_id": "r2", "transfer_direction": "IN"}),
        ("2024-01-05", "TRANSFER", 2, 0, {**K, "asset": "DOT", "trade_group_id": "r2", "transfer_direction": "IN"}),
        ("2024-02-01", "TRANSFER", 1, 0, {**K, "asset": "ETH", "transfer_direction": "IN"}),
        ("2024-02-02", "TRANSFER", 1, 0, {**K, "asset": "ETH", "transfer_direction": "IN"}),
        ("2024-02-08", "SELL", 1.004, 1004, {**K, "asset": "ETH", "fiat_currency": "EUR"}),
        ("2024-02-01", "SELL", 0.002, 0, {"source": "x"}),
        ("2024-02-01", "SELL", 5, 0, {**K, "asset": None}),
    ]
    got = by_id(V.venue_repairs(ledger(spark, rows)))
    assert len(got) == len(rows)
    assert [got[f"t{i:02}"].transaction_type for i in range(11)] == ["SELL", "FEE", "BUY", "TRANSFER", "SELL", "BUY", "BUY", "BUY", "TRANSFER", "SELL", "SELL"]
    assert (got["t00"].fiat_value_at_trigger, got["t00"].fee_fiat, got["t00"].counter_asset, got["t00"].counter_amount) == (300, 0, "GBP", 300)
    assert (got["t03"].transfer_direction, got["t04"].counter_asset, got["t04"].counter_amount) == ("OUT", "DOT", 1)
    assert (got["t05"].fiat_value_at_trigger, got["t06"].fiat_value_at_trigger, got["t05"].transfer_direction) == (33.33, 66.67, None)
    assert (got["t07"].fiat_value_at_trigger, got["t07"].fiat_currency, got["t08"].transfer_direction) == (1000, "EUR", "IN")


def test_micro_fees_against_fold(spark):
    rows, held, want = [], 0.0, set()
    for i in range(60):
        q = (i * 7 % 11 + 1) / 4000
        kind, v = ("BUY" if i % 5 == 0 else "SELL"), (9 if i % 7 == 3 else 0)
        rows.append((f"2024-01-01T{i // 60:02}:{i % 60:02}", kind, q, v, K))
        if kind == "BUY":
            held += q
        elif v <= 0 and q <= V.MICRO_FEE and q > held + 1e-12:
            want.add(f"t{i:02}")
        else:
            held = max(0.0, held - q)
    got = {r.id for r in V.micro_fees(ledger(spark, rows)).collect() if r.transaction_type == "FEE"}
    assert got == want and want


def test_stable_quotes(spark):
    at = "2024-01-01T10:00:00"
    rows = [
        (at, "SELL", 1, 100, {"source": "b"}), (at + ".500", "BUY", 101.9, 0, {"source": "b", "asset": "USDT"}), (at, "BUY", 102.1, 0, {"source": "b", "asset": "USDC"}), (at, "BUY", 1, 0, {"source": None, "asset": "ADA"}),
        (at, "SELL", 0, 0, {"source": None, "asset": "DAI"}), (at, "BUY", 2, 50, {"source": "c"}), ("2024-01-01T10:00:01", "SELL", 50, 0, {"source": "c", "asset": "USDT"}), (at, "BUY", 99, 0, {"source": "b", "asset": "USDC"}),
    ]
    got = by_id(V.stable_quotes(ledger(spark, rows)))
    assert set(got) == {"t00", "t01", "t02", "t03", "t05", "t06"}
    assert (got["t00"].counter_asset, got["t00"].fiat_currency, got["t03"].counter_asset, got["t05"].counter_asset) == ("USDC", "USDC", "DAI", None)
    assert V.stable_quotes(ledger(spark, rows).limit(0)).count() == 0
