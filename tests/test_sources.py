"""Parsers on small exports, and streams against batch."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from coinfold.sources import exports as X
from coinfold.sources import files
from coinfold.streaming import ledger_stream as LS


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def load(spark, tmp_path, name, text):
    df = files.read_export(spark, write(tmp_path, name, text))
    return df, files.detect_layout(df.columns)


def test_kraken(spark, tmp_path):
    df, kind = load(spark, tmp_path, "k.csv", '"txid","refid","time","type","subtype","asset","amount","fee"\n"a","r0","2023-07-14 20:58:26","deposit","","GBP",100,0\n"b","r1","2023-07-15 21:27:37","trade","","ZGBP",-100,0\n"c","r1","2023-07-15 21:27:37","trade","","XXBT",0.002,0\n"d","r1","2023-07-15 21:27:37","trade","","XXBT",0.001,0\n"e","r2","2023-07-16 00:00:00","withdrawal","","XXBT",-0.001,0.0001\n"f","r3","2023-07-16 00:00:00","staking","","XETH",0.1,0\n"g","r4","2023-07-16 00:00:00","deposit","","USDT",50,0\n')
    assert kind == "kraken"
    got = {r.id: r for r in X.parse_kraken(df).collect()}
    assert set(got) == {"c", "e", "f", "g"}
    assert (got["c"].transaction_type, got["c"].asset, got["c"].amount, got["c"].fiat_value_at_trigger, got["c"].fiat_currency) == ("BUY", "BTC", pytest.approx(0.003), 100.0, "GBP")
    assert (got["e"].transaction_type, got["e"].transfer_direction) == ("TRANSFER", "OUT") and got["f"].transaction_type == "STAKING" and got["g"].fiat_value_at_trigger == 50


def test_exchange_ledger(spark, tmp_path):
    df, kind = load(spark, tmp_path, "b (UTC+1).csv", "User_ID,Time,Account,Operation,Coin,Change,Remark\n1,2024-01-01 10:00:00,Spot,Transaction Related,BTC,0.5,\n1,2024-01-01 10:00:00,Spot,Transaction Related,GBP,-100,\n1,2024-01-02 10:00:00,Spot,Airdrop,ABC,3,\n1,2024-01-02 11:00:00,Spot,Crypto Deposit,ETH,1,\n1,2024-01-03 11:00:00,Spot,Staking Purchase,ETH,-1,\n")
    assert kind == "exchange_ledger"
    got = {r.asset: r for r in X.parse_exchange_ledger(df, "b (UTC+1).csv").collect()}
    assert set(got) == {"BTC", "ABC", "ETH"} and got["BTC"].timestamp == datetime(2024, 1, 1, 9) and got["BTC"].fiat_value_at_trigger == 100 and got["BTC"].source == "binance"
    assert got["ABC"].transaction_type == "AIRDROP" and got["ETH"].transfer_direction == "IN"


def test_woox(spark, tmp_path):
    df, kind = load(spark, tmp_path, "w.csv", "Order ID,Create Time,Instrument,Type,Side,Price,Quantity,Executed,Average Price,Status,Total Fee,Fee Token,Realized Pnl\n1,2025-07-11 16:07:11,PERP_BTC_USDT,LIQUIDATE,SELL,2,3,3,2.5,FILLED,0.07,USDT,-1.6\n2,2025-07-11 16:07:11,SPOT_ETH_USDT,LIMIT,BUY,-,3,3,4,FILLED,0.1,ETH,-\n3,2025-07-11 16:07:11,PERP_BTC_USDT,LIMIT,BUY,2,3,0,0,CANCELLED,0,USDT,-\n")
    assert kind == "woox"
    a, b = X.parse_woox(df).orderBy("id").collect()
    assert (a.asset, a.instrument_kind, a.fiat_value_at_trigger, a.fee_fiat, a.realized_pnl) == ("BTC", "perp", 7.5, 0.07, -1.6)
    assert (b.fee_fiat, b.realized_pnl, b.instrument_kind) == (0.0, None, "spot")


def test_variational(spark, tmp_path):
    df, kind = load(spark, tmp_path, "v.csv", "id,created_at,qty,asset,transfer_type,status,underlying,instrument_type,fee_type\nd,2025-11-20T16:57:51Z,321.5,USDC,deposit,confirmed,,,\nf,2025-11-20T16:57:51Z,-0.1,USDC,fee,confirmed,,,deposit\np,2025-11-20T16:47:02Z,-114.7,USDC,realized_pnl,confirmed,SOL,perpetual_future,\n")
    assert kind == "variational"
    got = {r.id: r for r in X.parse_variational(df).collect()}
    assert set(got) == {"variational-d", "variational-p"} and got["variational-d"].fee_fiat == pytest.approx(0.1) and got["variational-p"].realized_pnl == -114.7


def test_generic_csv_and_json(spark, tmp_path):
    df, kind = load(spark, tmp_path, "g.csv", "Date,Coin,Action,Quantity,Total\n2024-01-01 00:00:00,btc,purchase,1,-5\nnever,btc,buy,1,1\n2024-01-01 00:00:00,eth,interest,2,10\n")
    assert kind == "generic"
    got = {r.asset: r for r in X.parse_generic(df).collect()}
    assert set(got) == {"BTC", "ETH"} and got["BTC"].fiat_value_at_trigger == 0 and got["ETH"].transaction_type == "STAKING"
    j = files.read_export(spark, write(tmp_path, "g.json", '{"transactions": [{"id": "x", "timestamp": "2024-01-01T00:00:00Z", "asset": "sol", "type": "sell", "amount": 2}]}'))
    assert X.parse_generic(j).first().id == "x"


def test_provider_payloads(spark):
    fills = spark.createDataFrame([("BTC", "100", "2", "B", 1700000000000, "7", "0.0"), ("@1", "1", "2", "A", 1700000000000, "8", "3.5")], "coin string, px string, sz string, side string, time long, tid string, closedPnl string")
    a, b = X.parse_hyperliquid(fills).orderBy("id").collect()
    assert (a.transaction_type, a.realized_pnl, a.instrument_kind, b.instrument_kind, b.realized_pnl) == ("BUY", None, "perp", "spot", 3.5)
    tx = spark.createDataFrame([("t" * 20, [("me", 5)], [(("me", 12),), (("you", 9),)], (1700000000,))], "txid string, vout array<struct<scriptpubkey_address:string,value:long>>, vin array<struct<prevout:struct<scriptpubkey_address:string,value:long>>>, status struct<block_time:long>")
    r = X.parse_bitcoin(tx, "ME").first()
    assert (r.transfer_direction, r.amount) == ("OUT", 7e-8)


@pytest.mark.parametrize("address,chain", [("0x" + "a" * 40, "ethereum"), ("bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bitcoin"), ("So11111111111111111111111111111111111111112", "solana"), ("nothing", None)])
def test_wallet_chain(spark, address, chain):
    assert spark.range(1).select(files.wallet_chain(F.lit(address))).first()[0] == chain


def test_pool_stream_equals_one_batch(spark, tmp_path):
    rows = [(f"r{i}", "BTC", datetime(2024, 1, 1 + i), "A" if i % 3 else "D", 1.0 + i, 10.0 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, asset string, timestamp timestamp, kind string, quantity double, value double")
    for i in range(3):
        df.where(F.dayofmonth("timestamp").between(3 * i + 1, 3 * i + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = LS.pooled(LS.read_ledger(spark, str(tmp_path / "in"), df.schema, 1)).writeStream.format("memory").queryName("pooled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r for r in spark.table("pooled").collect()}
    assert got["r3"].quantity == 4.0 and got["r3"].cost == pytest.approx(round((10 + 20) * 4 / 5, 2)) and got["r6"].pool_quantity == pytest.approx(1 + 11 - 7)


def test_stream_dedup(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1), "BUY", 1.0), ("a", datetime(2024, 1, 1), "BUY", 1.0), ("b", datetime(2024, 1, 1), "BUY", 2.0)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, transaction_type string, fiat_value_at_trigger double")
    df.write.parquet(str(tmp_path / "in"))
    q = LS.deduplicated(LS.read_ledger(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("dd").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").count() == 2
