"""Missing legs of an app, values carried along a key, and uploads by layout."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coinfold.functions.spread import carried
from coinfold.operators import app_legs as A
from coinfold.sources import uploads
from coinfold.sources.testdata import LEDGER

AT = datetime(2024, 1, 1, 10)


def ledger(spark, rows):
    names = [x.strip().split(" ")[0] for x in LEDGER.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LEDGER)


def leg(i, kind, asset, counter, amount, counter_amount=None, value=100.0, minutes=0, **more):
    return {"id": f"cdc-{i}-crypto_exchange-{i}", "timestamp": AT + timedelta(minutes=minutes), "asset": asset, "transaction_type": kind, "amount": amount, "counter_asset": counter, "counter_amount": counter_amount, "fiat_value_at_trigger": value, "fiat_currency": "USD", "source": "cryptocom", "seq": i} | more


def test_missing_legs(spark):
    rows = [
        leg(1, "BUY", "ETH", "CRO", 1.0, 50.0), leg(2, "SELL", "ADA", "DOT", 9.0, 3.0, minutes=1), leg(3, "BUY", "ETH", "USDT", 1.0, 90.0, minutes=2), leg(4, "BUY", "ETH", "EUR", 1.0, 90.0, minutes=3),
        leg(5, "BUY", "BTC", "LTC", 1.0, minutes=4), leg(6, "SELL", "LTC", "BTC", 7.0, minutes=4),  # both there: amounts from each other
        leg(7, "BUY", "XRP", "SOL", 5.0, minutes=10), {"id": "p0", "timestamp": AT, "asset": "SOL", "transaction_type": "BUY", "amount": 2.0, "fiat_value_at_trigger": 50.0, "source": "kraken"},  # price of an earlier purchase
        leg(8, "BUY", "XRP", "DOT", 5.0, minutes=20), {"id": "p1", "timestamp": AT + timedelta(minutes=29), "asset": "DOT", "transaction_type": "BUY", "amount": 4.0, "fiat_value_at_trigger": 20.0, "source": "kraken"},
        leg(9, "BUY", "XRP", "LTC", 5.0, minutes=40), {"id": "p2", "timestamp": AT + timedelta(minutes=55), "asset": "LTC", "transaction_type": "BUY", "amount": 4.0, "fiat_value_at_trigger": 20.0, "source": "kraken"},  # too late
        leg(10, "BUY", "A", "B", 1.0, 2.0, minutes=60), leg(11, "BUY", "C", "B", 1.0, 3.0, minutes=60), leg(12, "BUY", "A", None, 1.0, minutes=61), leg(13, "BUY", "Q", "R", 1.0, 2.0, minutes=62, source="kraken"),
    ]
    out = A.missing_legs(ledger(spark, rows))
    got = {r.id: r for r in out.collect()}
    new = {(r.transaction_type, r.asset, r.amount, r.counter_asset, r.fiat_value_at_trigger) for i, r in got.items() if i not in {x["id"] for x in rows}}
    assert new == {("SELL", "CRO", 50.0, "ETH", 100.0), ("BUY", "DOT", 3.0, "ADA", 100.0), ("SELL", "SOL", 4.0, "XRP", 100.0), ("SELL", "DOT", 20.0, "XRP", 100.0), ("SELL", "B", 2.0, "A", 100.0)}
    assert got["cdc-5-crypto_exchange-5"].counter_amount == 7.0 and got["cdc-6-crypto_exchange-6"].counter_amount == 1.0 and got["cdc-9-crypto_exchange-9"].counter_amount is None
    assert got["cdc-1-crypto_exchange-1"].trade_group_id == "cdc-xchg-2024-01-01T10:00:00+00:00" == got["cdc-2024-01-01T10:00:00+00:00-crypto_exchange-sell-CRO"].trade_group_id and got["cdc-5-crypto_exchange-5"].trade_group_id is None
    assert A.missing_legs(out).count() == out.count()
    assert A.missing_legs(ledger(spark, [])).count() == 0


def test_values_are_carried_over_ranges(spark):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), i, rnd.randint(0, 9) if rnd.random() < 0.05 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(7)
    got = {r.i: r.last for r in carried(df, "k", [F.col("i")], F.col("v"), "last").collect()}
    back = {r.i: r.last for r in carried(df, "k", [F.col("i").desc()], F.col("v"), "last").collect()}
    for order, found in ((rows, got), (rows[::-1], back)):
        now, want = {}, {}
        for k, i, v in order:
            now[k] = v if v is not None and k is not None else now.get(k)
            want[i] = now[k]
        assert found == want
    assert carried(df.limit(0), "k", [F.col("i")], F.col("v"), "last").count() == 0


UPLOADS = {
    "kraken": ("k.csv", '"txid","refid","time","type","subtype","asset","amount","fee"\n"c","r","2023-07-15 21:27:37","staking","","ETH",0.5,0\n'),
    "exchange_ledger": ("b.csv", "User_ID,Time,Account,Operation,Coin,Change,Remark\n1,2024-01-01 10:00:00,Spot,Distribution,ABC,7,\n"),
    "cosmos_wallet": ("c.csv", "type,from,to,txhash,amount,timestamp,denom,totalPrice\nGetReward,celestiavaloper1,celestia1me,H1,2,2024-01-01T00:00:00Z,utia,20\n"),
    "cryptocom": ("app.csv", "Timestamp (UTC),Transaction Description,Currency,Amount,To Currency,To Amount,Native Currency,Native Amount,Native Amount (in USD),Transaction Kind\n2024-01-01 10:00:00,Buy CRO,CRO,10,,,USD,1,1,crypto_purchase\n"),
    "solana_wallet": ("s.csv", "Signature,Human Time,Action,From,To,Amount,Flow,Value,Decimals,Token Address,Multiplier\nsig,2024-01-01 10:00:00,transfer,x,me,5000000,in,5,6,EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v,1\n"),
    "evm_wallet_csv": ("export-0x" + "a" * 40 + ".csv", f"Transaction Hash,DateTime (UTC),From,To,Amount\n0xh,2024-01-01 10:00:00,0x{'b' * 40},0x{'a' * 40},1.5\n"),
    "generic": ("ledger.data", '[{"id": "x", "timestamp": "2024-01-01T10:00:00Z", "asset": "ETH", "type": "buy", "amount": "2", "usd_value": "9"}]'),
}


@pytest.mark.parametrize("layout", UPLOADS)
def test_uploads_find_their_parser(spark, tmp_path, layout):
    name, text = UPLOADS[layout]
    (tmp_path / name).write_text(text)
    found, rows = uploads.parse_upload(spark, str(tmp_path / name))
    assert found == layout and rows.count() == 1
    assert set(uploads.PARSERS) >= set(UPLOADS)
    if layout == "generic":
        r = uploads.preview_upload(spark, str(tmp_path / name)).first()
        assert (r.parser, r.n_rows, r.date_start) == ("generic", 1, datetime(2024, 1, 1, 10))
