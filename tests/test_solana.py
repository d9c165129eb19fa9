"""Explorer rows by route, token registry and labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coinfold.operators import registry as G
from coinfold.sources import solana as N

ME = "Wa11et1111111111111111111111111111111111111"
SHARES = "FiM4VQdXXnTXL7GgChryf9zHNG9cmvKECwf34L2y3CkN"
USDC = "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"
MSOL = "mSoLzYCxHdYgdzU16g5QSh3i5K3z3KZK7ytfqcJm7So"
JTO = "jtojtome8JDRCnn4g1NSEzNoYRrGjoc15W3DjcnMnvJB"
POOL = "PooLShare1111111111111111111111111111111111"
MEME = "MemeCoinMint111111111111111111111111111111"
COLUMNS = ("signature", "human_time", "action", "from", "to", "amount", "flow", "value", "decimals", "multiplier", "token_address", "token", "token_change", "helius_source", "helius_type")


@pytest.fixture(scope="module")
def tokens(spark):
    listed = [(MEME, "meme", "Meme Coin", 6), ("Zzzz1111111111111111111111111111111111111", "BTC", "Fake", 6), ("ABCDEFGHrest1111111111111111111111111111", "ONE", "One", 6), ("abcdefghREST2222222222222222222222222222", "TWO", "Two", 6), ("", "X", "no mint", 1), ("Noticker111111111111111111111111111111111", " ", "none", 1)]
    return G.token_registry(spark.createDataFrame([(*r, i) for i, r in enumerate(listed)], "mint string, symbol string, name string, decimals int, rank long")).cache()


def row(sig, flow, amount, mint="", token="", value=0, decimals=0, who="", **more):
    me, other = (ME, who) if flow == "out" else (who, ME)
    base = {"signature": sig, "human_time": "2024-06-01 12:00:00", "action": "transfer", "from": me, "to": other, "amount": amount, "flow": flow, "value": value, "decimals": decimals, "multiplier": 1, "token_address": mint, "token": token}
    return tuple(None if (base | more).get(c) is None else str((base | more)[c]) for c in COLUMNS)


FARM, LENDER = N.FARM_AUTHORITIES[0], N.LENDING_AUTHORITIES[0]
SHORT = "PooL…1111"
#: Rows of each case and the ledger rows that it has to give: type, direction, asset, amount, value, counter asset, order type.
CASES = {
    "swap: hops are netted, the side without a value takes the other's": (
        [row("s1", "out", 2_000_000_000, token="SOL", decimals=9, value=300), row("s1", "in", 100, USDC, decimals=0), row("s1", "out", 100, USDC), row("s1", "in", 1_500_000, MEME, decimals=6)],
        [("BUY", None, "MEME", 1.5, 300.0, "SOL", None), ("SELL", None, "SOL", 2.0, 300.0, "MEME", None)],
    ),
    "claim of an airdrop": (
        [row("c1", "out", 5_000_000, token="SOL", decimals=9, value=0.75), row("c1", "in", 9_000_000, MEME, decimals=6)],
        [("AIRDROP", None, "MEME", 9.0, 0.75, None, None), ("FEE", None, "SOL", 0.005, 0.75, None, None)],
    ),
    "vault: wrapped and native coin count once if about equal": (
        [row("v1", "out", 50, SHARES), row("v1", "in", 3, N.WRAPPED, value=400), row("v1", "in", 3.001, token="SOL")],
        [("TRANSFER", "IN", "SOL", 3.001, 400.0, None, None)],
    ),
    "vault: else both": ([row("v2", "in", 50, SHARES), row("v2", "out", 3, N.WRAPPED), row("v2", "out", 1, token="SOL")], [("TRANSFER", "OUT", "SOL", 4.0, 0.0, None, None)]),
    "margin": ([row("d1", "out", 5, USDC, value=5, helius_source="drift"), row("d1", "in", 7, MEME)], [("TRANSFER", "OUT", "USDC", 5.0, 5.0, None, "drift_collateral")]),
    "lending: principal, no receipts and rent": (
        [row("l1", "in", 4, MSOL, who=LENDER, value=9), row("l1", "out", 4, POOL), row("l1", "out", 2039280, token="SOL", decimals=9)], [("TRANSFER", "IN", "MSOL", 4.0, 9.0, None, None)],
    ),
    "lending: one way": ([row("l2", "out", 4, USDC, helius_type="X_MARGINFI_Y")], [("TRANSFER", "OUT", "USDC", 4.0, 0.0, None, None)]),
    "farm: swap, then stake": (
        [row("f1", "out", 1, token="SOL", value=150), row("f1", "in", 60, JTO), row("f1", "out", 60, JTO, who=FARM), row("f1", "in", 60, POOL, who=FARM)],
        [("BUY", None, "JTO", 60.0, 150.0, "SOL", None), ("SELL", None, "SOL", 1.0, 150.0, "JTO", None), ("TRANSFER", "OUT", "JTO", 60.0, 150.0, None, None)],
    ),
    "pool: shares are minted": (
        [row("p1", "out", 1, N.WRAPPED, value=145), row("p1", "out", 150, USDC, value=150), row("p1", "in", 100, POOL, token_change="mint")],
        [("TRANSFER", "IN", SHORT, 100.0, 0.0, None, "amm_lp"), ("TRANSFER", "OUT", "SOL", 1.0, 145.0, None, "amm_lp_pool"), ("TRANSFER", "OUT", "USDC", 150.0, 150.0, None, "amm_lp_pool")],
    ),
    "pool: shares are burnt, a provider names it": (
        [row("p2", "in", 7, MEME, helius_source="PUMP_AMM", helius_type="WITHDRAW"), row("p2", "out", 40, POOL, token_change="burn")],
        [("TRANSFER", "IN", "MEME", 7.0, 0.0, None, "amm_lp_pool"), ("TRANSFER", "OUT", SHORT, 40.0, 0.0, None, "amm_lp")],
    ),
    "no pool: nobody names it and only meme coins move": ([row("p3", "in", 7, MEME), row("p3", "out", 40, POOL, token_change="burn")], [("BUY", None, "MEME", 7.0, 0.0, SHORT, None)]),
    "transfers": ([row("t1", "in", 5, USDC, value=5, who="friend"), row("t1", "in", 5, USDC, value=5, who="friend")], [("TRANSFER", "IN", "USDC", 5.0, 5.0, None, None)]),
    "no signature": ([row("", "out", 2, token="SOL", decimals=0, value=-1)], [("TRANSFER", "OUT", "SOL", 2.0, 0.0, None, None)]),
    "no flow": ([row("t4", "", 4, USDC)], [("TRANSFER", "IN", "USDC", 4.0, 0.0, None, None)]),
    "ticker cut off": ([row("t8", "in", 1, token="MEMECOIN")], [("TRANSFER", "IN", "MEME", 1.0, 0.0, None, None)]),
    "left out": (
        [row("t2", "in", 3, POOL), row("t3", "in", 0.00005, token="SOL"), row("t5", "in", 4, USDC, action="close account"), row("t6", "in", 4, USDC, human_time="soon"), row("t7", "in", "nan", USDC), row("t9", "in", 6, token="www.claim.com"), row("t10", "in", 7, USDC, decimals=-1)], [],
    ),
    "decimals by value": ([row("q1", "in", 2_000_000_000, token="SOL", value=300)], [("TRANSFER", "IN", "SOL", 2.0, 300.0, None, None)]),
    "decimals of large amounts without a value": ([row("q3", "in", 1_500_000_000, USDC)], [("TRANSFER", "IN", "USDC", 1.5, 0.0, None, None)]),
    "small amounts have none": ([row("q5", "in", 999, USDC, value=999)], [("TRANSFER", "IN", "USDC", 999.0, 999.0, None, None)]),
}


@pytest.fixture(scope="module")
def ledger(spark, tokens):
    rows = [r for given, _ in CASES.values() for r in given]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLUMNS)).repartition(3).withColumn("extra", F.lit(1))
    out = N.parse_solana(df, tokens, wallet=ME).collect()
    assert len({r.id for r in out}) == len(out)
    return out


@pytest.mark.parametrize("case", CASES)
def test_routes(ledger, case):
    given, want = CASES[case]
    sigs = {r[0] for r in given}
    got = [r for r in ledger if (r.on_chain_tx_id or "") in sigs]
    assert sorted(((r.transaction_type, r.transfer_direction, r.asset, r.amount, r.fiat_value_at_trigger, r.counter_asset, r.venue_order_type) for r in got), key=str) == sorted(want, key=str)


def test_ids_and_counterparties(ledger):
    by_id = {r.id: r for r in ledger}
    assert {i for i in by_id if "-f1-" in i} == {"sol-f1-buy-JTO", "sol-f1-sell-SOL", "sol-f1-transfer-out-JTO"}
    assert by_id["sol-f1-transfer-out-JTO"].counterparty_address == FARM and by_id["sol-l1-transfer-in-MSOL"].counterparty_address == LENDER and by_id["sol-d1-transfer-out-USDC"].counterparty_address == N.DRIFT_PROGRAM
    assert by_id[f"sol-t1-transfer-in-{USDC}"].counterparty_address == "friend" and by_id["sol-2024-06-01T12:00:00+00:00-transfer-out-SOL"].trade_group_id is None
    assert f"sol-p1-lp-mint-{POOL}" in by_id and by_id["sol-v1-transfer-in-SOL"].token_mint == N.WRAPPED


def test_no_rows_and_missing_columns(spark, tokens):
    df = spark.createDataFrame([("s", "2024-06-01 12:00:00", "other", "1")], "signature string, human_time string, action string, amount string")
    assert N.parse_solana(df, tokens).collect() == []


def test_registry_lookups(spark, tokens):
    def frag(*texts):
        return {r.text: r.token.symbol for r in G.resolved_fragments(spark.createDataFrame([(t,) for t in texts], "text string"), tokens).collect()}
    got = frag("MEMECOIN", "memec", "ABCDEFGH", "abcdefgh", "ABCDEFGHR", "abcdef", "abcdefghrest1", "JTOJTOME", "BTC", "Zzz", "nope", "EPjF")
    assert got == {"MEMECOIN": "MEME", "memec": "MEME", "ABCDEFGH": "ONE", "abcdefgh": "ONE", "abcdefghrest1": "ONE", "JTOJTOME": "JTO", "EPjF": "USDC"}
    labels = {r.text: r.token.symbol for r in G.resolved_labels(spark.createDataFrame([("FiM4…3CkN",), ("FiM4...3CkN",), ("fim4…3CkN",), ("A…1",), ("M…1",)], "text string"), tokens).collect()}
    assert labels == {"FiM4…3CkN": "KAMINOVAULT", "FiM4...3CkN": "KAMINOVAULT", "A…1": "ONE", "M…1": "MEME"}
    assert {r.symbol for r in G.by_symbol(tokens).collect()} >= {"MEME", "ONE"} and not {r.symbol for r in G.by_symbol(tokens).collect()} & {"BTC", "SOL", "USDC"}


def test_labels_in_their_order(spark, tokens):
    rows = [("MEME", MEME, None, "solana"), ("USDТ", None, "TWO", "kraken"), ("FiM4…3CkN", None, None, "solana"), ("Qq…Zz", None, None, "solana"), ("ONE", None, None, "kraken"), ("TWO", None, "ONE", "solana"), (POOL, None, "BTC", "solana"), ("AAVE", None, "", None), (None, None, "MEMECOIN", "solana")]
    ledger = spark.createDataFrame(rows, "asset string, token_mint string, counter_asset string, source string")
    got = {r.asset: (r.symbol, r.name, r.mint, r.resembles) for r in G.asset_labels(ledger, tokens).collect()}
    assert got == {
        "MEME": ("MEME", "Meme Coin", MEME, None), "USDТ": ("USDТ", "Unverified token (possible scam)", None, "USDT"), "FiM4…3CkN": ("KAMINOVAULT", "Kamino Earn SOL Vault Shares", SHARES, None), "Qq…Zz": ("Qq…Zz", "Unknown SPL token", None, None),
        "ONE": ("ONE", "ONE", "ABCDEFGHrest1111111111111111111111111111", None), "TWO": ("TWO", "TWO", "abcdefghREST2222222222222222222222222222", None), POOL: ("PooL…1111", "Unknown SPL token", POOL, None), "BTC": ("BTC", "Bitcoin", None, None),
        "AAVE": ("AAVE", "AAVE", None, None), "MEMECOIN": ("MEME", "Meme Coin", MEME, None),
    }


def test_fragments_of_a_ledger_are_renamed(spark, tokens):
    rows = [("MEMECOIN", None, "abcdef", "solana"), ("MEMECOIN", "m", None, "solana"), ("MEMECOIN", None, None, "kraken"), (None, None, "ABCDEFGH", None), ("SOL", None, "MSOL", "solana")]
    ledger = spark.createDataFrame(rows, "asset string, token_mint string, counter_asset string, source string")
    got = sorted(map(tuple, G.renamed_fragments(ledger, tokens).collect()), key=str)
    assert got == sorted([("MEME", MEME, "abcdef", "solana", True), ("MEMECOIN", "m", None, "solana", False), ("MEMECOIN", None, None, "kraken", False), (None, None, "ONE", None, True), ("SOL", None, "MSOL", "solana", False)], key=str)
    assert G.renamed_fragments(ledger, tokens.limit(0)).where("renamed").count() == 0
