from __future__ import annotations

from datetime import date

import pytest

from coinfold.operators import classifiers as C
from coinfold.operators import pairing as P

from tests.test_ledger import ledger


def g(asset, gid="g", **more):
    return {"asset": asset, "trade_group_id": gid, "source": "solana", **more}


def kinds(df):
    return {r.id: (r.asset, r.transaction_type, r.transfer_direction, r.event_subtype) for r in df.collect()}


def test_claims_and_trades(spark):
    x = ledger(spark, [("2024-01-01", "BUY", 100, 0, g("ABC")), ("2024-01-01", "SELL", 0.001, 0.2, g("SOL")), ("2024-01-01", "AIRDROP", 100, 0, g("DEF", "h")), ("2024-01-01", "FEE", 2, 300, g("SOL", "h")), ("2024-01-01", "AIRDROP", 1, 1, {"id": "crypto_earn_interest_paid-1", "source": "cryptocom"})])
    y = C.income(x)
    k = kinds(y)
    assert [k[i][1] for i in ("t00", "t01", "t02", "t03")] == ["AIRDROP", "FEE", "BUY", "SELL"] and k["crypto_earn_interest_paid-1"][1] == "STAKING"
    assert kinds(C.income(y)) == k and {r.id: r.fiat_value_at_trigger for r in y.collect()}["t02"] == 300


def test_vault_lending_margin(spark):
    share = C.VAULT_SHARES[0]
    x = ledger(spark, [("2024-01-01", "SELL", 4, 100, g("SOL")), ("2024-01-01", "BUY", 1, 100, g("KV", token_mint=share)), ("2024-01-01", "SELL", 5, 5, g("USDG", "l", on_chain_tx_id="h", counterparty_address=C.LENDING_PROGRAMS[0])), ("2024-01-01", "SELL", 5, 5, g("USDC", "m", counterparty_address=C.MARGIN_PROGRAMS[0])), ("2024-01-01", "SELL", 5, 5, g("JTO", "n"))])
    k = kinds(C.margin_collateral(C.lending(C.vaults(x))))
    assert set(k) == {"t00", "t02", "t03", "t04"} and {i: v[1] for i, v in k.items()} == {"t00": "TRANSFER", "t02": "TRANSFER", "t03": "TRANSFER", "t04": "SELL"}
    assert {r.id: r.amount for r in C.vaults(x).collect()}["t00"] == 2
    t = C.lending_for_tax(C.lending(C.vaults(x)))
    assert kinds(t)["t02"][1:] == ("SELL", None, "lend_deposit") and kinds(C.lending_for_tax(t)) == kinds(t)


def test_liquidity(spark):
    x = ledger(spark, [("2024-01-01", "TRANSFER", 1, 145, g("SOL", "lp-add-1", transfer_direction="OUT")), ("2024-01-01", "TRANSFER", 150, 150, g("ABC", "lp-add-1", transfer_direction="OUT")), ("2024-01-02", "TRANSFER", 1, 100, g("SOL", "r", transfer_direction="IN")), ("2024-01-02", "TRANSFER", 9, 50, g("ABC", "r", transfer_direction="IN")), ("2024-01-03", "BUY", 1, 1, g("ABC", "z"))])
    y = C.liquidity_for_tax(x)
    k = kinds(y)
    assert k["lp-acquire-lp-add-1"] == ("LP:LP-ADD-1", "BUY", None, "lp_add") and k["t00"][1:] == ("SELL", None, "lp_add") and k["t02"][1:] == ("BUY", None, "lp_remove") and k["t04"][3] is None
    assert {r.id: r.fiat_value_at_trigger for r in y.collect()}["lp-acquire-lp-add-1"] == 295
    assert kinds(C.liquidity_for_tax(y)) == k and kinds(C.liquidity_for_tax(x, "basis_neutral")) == kinds(x)


@pytest.mark.parametrize("policy,value", [("fmv", 40.0), ("zero", 0.0)])
def test_hard_fork(spark, policy, value):
    e = spark.createDataFrame([("ETHW", "ETH", date(2022, 9, 15), 1.0, 20.0)], "asset string, parent string, day date, ratio double, price double")
    x = ledger(spark, [("2022-01-01", "BUY", 3, 1, {"asset": "ETH"}), ("2022-02-01", "SELL", 1, 1, {"asset": "ETH"}), ("2022-09-15", "BUY", 9, 1, {"asset": "ETH"})])
    y = C.hard_forks(x, e, policy)
    n = y.where("event_subtype = 'hard_fork'").first()
    assert (n.id, n.amount, n.fiat_value_at_trigger) == ("hard-fork-ethw-2022-09-15", 2.0, value) and C.hard_forks(y, e, policy).count() == y.count()


def test_swaps_pairs_and_copies(spark):
    t = lambda a, w, h: {"asset": a, "transfer_direction": w, "on_chain_tx_id": h}
    x = ledger(spark, [("2024-01-01", "TRANSFER", 1, 0, t("A", "OUT", "h")), ("2024-01-01", "TRANSFER", 2, 0, t("B", "IN", "h")), ("2024-01-01", "TRANSFER", 1, 0, t("A", "OUT", "k")), ("2024-01-01", "TRANSFER", 1, 0, t("A", "IN", "k"))])
    k = kinds(C.disguised_swaps(x))
    assert (k["t00"][1], k["t01"][1], k["t02"][1]) == ("SELL", "BUY", "TRANSFER")
    p = C.pair_values(ledger(spark, [("2024-01-01", "TRANSFER", 2, 0, {"transfer_pair_id": "p"}), ("2024-01-01", "TRANSFER", 4, 100, {"transfer_pair_id": "p"})]))
    assert {r.id: r.fiat_value_at_trigger for r in p.collect()} == {"t00": 50.0, "t01": 100.0}
    z = ledger(spark, [(f"2024-01-01T0{i}:00", "BUY", 1, 1, {"source": "binance"}) for i in range(3)] + [("2024-01-01T09:00", "BUY", 1, 1, {"source": "binance"})])
    assert {r.id for r in C.timezone_copies(z).collect()} == {"t00", "t02", "t03"}


@pytest.mark.parametrize("minute,source,more,pairs", [("04", "b", {}, 1), ("06", "b", {}, 0), ("04", "a", {}, 0), ("04", "b", {"counter_asset": "USD"}, 0)])
def test_mistyped_transfers(spark, minute, source, more, pairs):
    x = ledger(spark, [("2024-01-01T00:00", "SELL", 1, 5, {"source": "a"}), (f"2024-01-01T00:{minute}", "BUY", 1, 5, {"source": source, **more})])
    p = P.mistyped_transfers(x)
    assert p.count() == pairs and P.as_transfers(x, p).where("transaction_type = 'TRANSFER'").count() == 2 * pairs


def test_normalise_is_idempotent(spark):
    x = ledger(spark, [("2024-01-01", "TRANSFER", 1, 145, g("SOL", "p", transfer_direction="OUT")), ("2024-01-01", "TRANSFER", 150, 150, g("ABC", "p", transfer_direction="OUT")), ("2024-01-05", "BUY", 1, 1, g("ABC", "z"))])
    y = C.normalise(x)
    assert kinds(C.normalise(y)) == kinds(y)
