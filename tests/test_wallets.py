from __future__ import annotations

from datetime import datetime

import pytest

from coinfold.sources import files
from coinfold.sources import wallets as W


def load(spark, tmp_path, text):
    p = tmp_path / "x.csv"
    p.write_text(text)
    df = files.read_export(spark, str(p))
    return df, files.detect_layout(df.columns)


def test_app_export(spark, tmp_path):
    head = "Timestamp (UTC),Transaction Description,Currency,Amount,To Currency,To Amount,Native Currency,Native Amount,Native Amount (in USD),Transaction Kind,Transaction Hash\n"
    df, kind = load(spark, tmp_path, head + "2024-01-01 10:00:00,BTC Deposit,BTC,0.5,,,GBP,0,0,crypto_deposit,\n2024-01-02 10:00:00,swap,DOT,-3,,,GBP,30,36,crypto_wallet_swap_debited,\n2024-01-02 10:00:00,swap,ADA,100,,,GBP,0,0,crypto_wallet_swap_credited,\n2024-01-03 10:00:00,Earn,CRO,1,,,GBP,0.5,0.6,crypto_earn_interest_paid,\n2024-01-04 10:00:00,Buy,USDC,9,,,GBP,8,9,crypto_purchase,\n2024-01-05 10:00:00,CRO -> ETH,CRO,-10,ETH,0.1,USD,20,20,crypto_exchange,\n")
    assert kind == "cryptocom"
    got = {r.asset: r for r in W.parse_cryptocom(df).collect() if r.amount != 10}
    assert set(got) == {"BTC", "DOT", "ADA", "CRO"} and got["BTC"].transfer_direction == "IN" and got["CRO"].transaction_type == "STAKING"
    assert (got["DOT"].transaction_type, got["DOT"].counter_asset, got["DOT"].fiat_value_at_trigger, got["ADA"].counter_asset) == ("SELL", "ADA", 30.0, "DOT")
    x = W.parse_cryptocom(df).where("amount = 10").first()
    assert (x.transaction_type, x.counter_asset, x.counter_amount) == ("SELL", "ETH", 0.1)


def test_evm(spark):
    at = datetime(2024, 1, 1)
    rows = [("h1", at, "token", "out", "USDX", 100.0), ("h1", at, "token", "in", "ABC", 5.0), ("h1", at, "fee", "out", "ETH", 0.01), ("h2", at, "native", "in", "ETH", 1.0), ("h3", at, "token", "in", "ABC", 1.0), ("h3", at, "token", "in", "DEF", 2.0), ("h4", at, "token", "in", "claim-x.com", 9.0)]
    got = {(r.trade_group_id, r.asset): r for r in W.parse_evm(spark.createDataFrame([(*r, None, "0xc") for r in rows], "hash string, timestamp timestamp, kind string, flow string, asset string, amount double, contract string, counterparty string"), "ethereum").collect()}
    assert {k: v.transaction_type for k, v in got.items()} == {("h1", "USDX"): "SELL", ("h1", "ABC"): "BUY", ("h1", "ETH"): "FEE", ("h2", "ETH"): "TRANSFER", ("h3", "ABC"): "TRANSFER", ("h3", "DEF"): "TRANSFER"}
    assert got["h1", "ABC"].counter_asset == "USDX" and got["h3", "DEF"].transfer_direction == "IN"



def test_evm_export(spark, tmp_path):
    me, you = "0x" + "a" * 40, "0x" + "b" * 40
    head = "Transaction Hash,DateTime (UTC),UnixTimestamp,From,To,Amount,Value_IN(ETH),Token Symbol,ContractAddress\n"
    text = head + f"h1,2024-01-01 10:00:00,,{me.upper().replace('X', 'x')},{you},100,,usdx,0xc\nh1,2024-01-01 10:00:00,,{you},{me},5,,,0xd\nh2,,1704067200,{you},{me},,1.5,,\nh3,,1704067200,{'0x' + 'c' * 40},0xdead,1,,,\n,,1704067200,{you},{me},1,,,\nh4,nan,,{you},{me},1,,,\nh5,,1704067200,{you},{me},0,,,\n"
    df, kind = load(spark, tmp_path, text)
    assert kind == "evm_wallet_csv"
    for name in ("", f"export-{me.upper()}.csv"):
        got = {(r.trade_group_id, r.asset): (r.transaction_type, r.amount, r.timestamp) for r in W.parse_evm_csv(df, name).collect()}
        assert got == {("h1", "USDX"): ("SELL", 100, datetime(2024, 1, 1, 10)), ("h1", "UNKNOWN"): ("BUY", 5, datetime(2024, 1, 1, 10)), ("h2", "ETH"): ("TRANSFER", 1.5, datetime(2024, 1, 1))}
    with pytest.raises(ValueError):
        W.evm_export_rows(df.limit(0))


def test_cosmos(spark, tmp_path):
    df, kind = load(spark, tmp_path, "type,from,to,txhash,amount,timestamp,denom,totalPrice\nGetReward,celestiavaloper1,celestia1me,H1,2,2024-01-01T00:00:00Z,utia,20\nSend,celestia1me,celestia1you,H2,3,2024-01-02T00:00:00Z,utia,\nSwap,celestia1me,celestia1you,H3,3,2024-01-02T00:00:00Z,utia,\nReceive,celestia1you,celestia1me,H4,1,2024-01-03T00:00:00Z,uosmo,5\n")
    assert kind == "cosmos_wallet"
    got = {r.asset + r.transaction_type + (r.transfer_direction or ""): r for r in W.parse_cosmos(df).collect()}
    assert set(got) == {"TIASTAKING", "TIATRANSFEROUT", "OSMOTRANSFERIN"} and got["TIASTAKING"].fiat_value_at_trigger == 20


def test_emails(spark):
    text = "Payment ID: p1\nDeposit Fiat Amount: 1,000 GBP\nReceived Crypto: 1,250 USDT\nDeposit Date: 2024-01-01 10:00:00\nProcessing Fee: 12.5 USDT\nWithdrawal Amount:\n 0.5 BTC\nWithdrawal Time: 2024-01-02 08:00:00(UTC+8)\nWithdrawal Address: bc1q\nTxID: tx9\nYour BTC_USDT futures SL order was filled completely at 2024-01-01 00:00:00."
    rows, notes = W.parse_emails(spark.createDataFrame([(text,), (None,), ("",)], "value string"))
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"mexc-deposit-p1", "mexc-withdraw-tx9"} and notes.count() == 1
    assert got["mexc-deposit-p1"].fee_fiat == pytest.approx(10) and got["mexc-withdraw-tx9"].timestamp == datetime(2024, 1, 2, 0, 0)


def test_chain_payloads(spark):
    io = "array<struct<payment:string,stake:string,value:string>>"
    a = spark.createDataFrame([("t" * 20, 1700000000, [("you", "s", "5000000")], [("x", "me", "2000000"), ("me", None, "1000000")])], f"tx_hash string, tx_timestamp long, inputs {io}, outputs {io}")
    r = W.parse_cardano(a, "me").first()
    assert (r.transfer_direction, r.amount) == ("IN", 3.0)
    ev = [("transfer", [("sender", "me"), ("recipient", "you"), ("amount", "2500000utia")]), ("tx", [])]
    t = spark.createDataFrame([("h", "2024-01-01T00:00:00Z", ev), ("h", "2024-01-01T00:00:00Z", ev)], "txhash string, timestamp string, events array<struct<type:string,attributes:array<struct<key:string,value:string>>>>")
    r = W.parse_celestia(t, "me").collect()
    assert [(x.transfer_direction, x.amount, x.counterparty_address) for x in r] == [("OUT", 2.5, "you")]
