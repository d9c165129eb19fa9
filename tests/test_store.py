"""The stored ledger: versions, writers that die or are overtaken, imports that can be repeated."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coinfold.operators import app_legs as A
from coinfold.operators import classifiers as C
from coinfold.operators import identity as I
from coinfold.operators import ledger_ops as L
from coinfold.operators import venue_repairs as V
from coinfold.operators import views as W
from coinfold.plans import ledger_store as T
from coinfold.sources.testdata import LEDGER, conform

START = datetime(2024, 1, 1)
FEW = [W.with_on_chain_ids, lambda x: x.where(~L.is_spam(F.col("asset"))), lambda x: x.where(~L.is_dust())]


def row(i, **more):
    return {"id": f"r{i}", "timestamp": START + timedelta(hours=i), "asset": "ETH", "transaction_type": "BUY", "amount": 1.0 + i, "fiat_value_at_trigger": 100.0 + i, "source": "kraken", "seq": i} | more


def ledger(spark, rows):
    names = [x.strip().split(" ")[0] for x in LEDGER.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LEDGER)


@pytest.fixture
def store(spark, tmp_path):
    return T.LedgerStore(spark, str(tmp_path / "ledger"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_the_same_file_twice_changes_nothing(spark, store):
    batch = ledger(spark, [row(1), row(2), row(2), row(3, asset="www.claim.com"), row(4, fiat_value_at_trigger=0.2)])
    one = T.import_batch(store, batch, "a", FEW, label="a.csv")
    assert (one.version, one.added, one.skipped, one.total) == (1, 4, 0, 2) and ids(store.read()) == ["r1", "r2"]
    two = T.import_batch(store, batch, "b", FEW, label="a.csv")
    assert (two.version, two.added, two.total) == (1, 0, 2) and store.versions() == [1]
    more = T.import_batch(store, ledger(spark, [row(2), row(5)]), "c", FEW)
    assert (more.version, more.added, more.skipped, more.total) == (2, 1, 1, 3)
    assert {(r.import_id, r.n_rows) for r in store.imports().collect()} == {("a", 4), ("c", 1)}
    assert ids(store.read(1)) == ["r1", "r2"] and {r.import_id for r in store.read().collect()} == {"a", "c"}


def test_known_rows_by_any_key(spark, store):
    first = [row(1), row(2, source="solana", trade_group_id="sig", transaction_type="SELL"), row(3, on_chain_tx_id="0xa")]
    T.import_batch(store, ledger(spark, first), "a", [])
    again = [row(1, id="other"), row(2, id="x", source="solana", trade_group_id="sig", transaction_type="SELL", fiat_value_at_trigger=9.0), row(3, id="y", on_chain_tx_id="0xa", fiat_value_at_trigger=7.0, timestamp=START), row(1, id="new", amount=9.0), row(6, id=None), row(6, id=None)]
    got = T.import_batch(store, ledger(spark, again), "b", [])
    assert (got.added, got.skipped) == (2, 3)


def test_copies_inside_a_batch(spark):
    rows = [row(1), row(1, fiat_value_at_trigger=500.0), row(2, id="a"), row(2, id="b", on_chain_tx_id=""), row(3, id="c", on_chain_tx_id="t"), row(3, id="d", on_chain_tx_id="t", fiat_value_at_trigger=900.0), row(4, id=None, source=None), row(4, id=None, source=None)]
    got = I.deduplicated(ledger(spark, rows)).collect()
    assert sorted((r.id or "", r.fiat_value_at_trigger) for r in got) == [("", 104.0), ("a", 102.0), ("d", 903.0 - 3), ("r1", 500.0)]
    assert I.deduplicated(ledger(spark, [])).collect() == []


def test_a_dead_writer_leaves_the_last_version(spark, store, monkeypatch):
    T.import_batch(store, ledger(spark, [row(1)]), "a", FEW)
    monkeypatch.setattr(store, "_name", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        T.import_batch(store, ledger(spark, [row(2)]), "b", FEW)
    fresh = T.LedgerStore(spark, store.path)
    assert fresh.versions() == [1] and ids(fresh.read()) == ["r1"]
    assert fresh.vacuum(older_than_ms=10**9) == 0 and fresh.vacuum(older_than_ms=0) == 1
    assert ids(fresh.read()) == ["r1"]


def test_an_overtaken_writer_changes_nothing(spark, store):
    x = ledger(spark, [row(1)])
    store.commit(x, store.imports(), None)
    with pytest.raises(T.Overtaken):
        store.commit(ledger(spark, [row(2)]), store.imports(), None)
    real = store.versions
    store.versions = lambda: []  # it looked before the other committed
    with pytest.raises((T.Overtaken, Exception)):
        store.commit(ledger(spark, [row(2)]), x.sparkSession.createDataFrame([], T.IMPORTS), None)
    store.versions = real
    assert store.versions() == [1] and ids(store.read()) == ["r1"]


def test_versions_can_be_restored_and_forgotten(spark, store):
    for i in range(1, 5):
        T.import_batch(store, ledger(spark, [row(i)]), f"i{i}", [])
    assert ids(store.read()) == ["r1", "r2", "r3", "r4"]
    assert store.restore(2) == 5 and ids(store.read()) == ["r1", "r2"]
    gone = T.disconnect(store, "i1")
    assert (gone.skipped, gone.total) == (1, 1) and ids(store.read()) == ["r2"] and [r.import_id for r in store.imports().collect()] == ["i2"]
    assert store.vacuum(keep=1, older_than_ms=0) == 4 and store.versions() == [6] and ids(store.read()) == ["r2"]
    with pytest.raises(KeyError):
        store.read(1)


def test_replace_demo_and_load(spark, store):
    demo = ledger(spark, [row(7)])
    store.commit(demo.unionByName(ledger(spark, [row(8), row(8), row(9, fiat_value_at_trigger=0.1)])), store.imports(), None)
    assert ids(store.load()) == ["r7", "r8"]
    assert T.import_batch(store, ledger(spark, [row(1)]), "a", FEW, demo=demo.select("id")).total == 2
    assert T.import_batch(store, ledger(spark, [row(2)]), "b", FEW, replace=True).total == 1 and [r.import_id for r in store.imports().collect()] == ["b"]


def test_rewrites_that_never_settle(spark):
    with pytest.raises(RuntimeError, match="settled"):
        T.settled(ledger(spark, [row(1)]), [lambda x: x.withColumn("amount", F.col("amount") + 1)], passes=3)
    twice = T.settled(ledger(spark, [row(1, amount=0.0)]), [lambda x: x.withColumn("amount", F.least(F.col("amount") + 1, F.lit(3.0)))])
    assert twice.first().amount == 3.0


def test_uploads_and_lost_imports(spark, store, tmp_path):
    (tmp_path / "up.csv").write_text("a,b\n1,2\n")
    assert open(store.keep_upload("imp", str(tmp_path / "up.csv"))).read() == "a,b\n1,2\n"
    rows = [row(1, import_id="x", source="binance"), row(2, import_id="x", source="binance"), row(3, import_id="y", source="hyperliquid"), row(4, import_id="y", source="ethereum"), row(5, import_id="z"), row(6)]
    known = spark.createDataFrame([("z",)], "import_id string")
    got = {r.import_id: (r.kind, r.label, r.chain, r.n_rows) for r in T.recovered_imports(conform(ledger(spark, rows)), known).collect()}
    assert got == {"x": ("csv", "Binance import (recovered)", None, 2), "y": ("wallet", "Ethereum wallet (recovered)", "ethereum", 2)}


def test_rewrites_of_groups_settle(spark, store):
    rows = [row(1), row(2, source="solana", transaction_type="TRANSFER", transfer_direction="OUT", asset="SOL", trade_group_id="g"), row(3, source="binance", transaction_type="STAKING"), row(4, source="binance", transaction_type="SELL", asset="USDT")]
    some = [W.with_on_chain_ids, W.repaired_groups, C.income, V.stable_quotes, A.missing_legs, C.timezone_copies]
    assert len(T.standard_rewrites()) == 17
    assert T.import_batch(store, ledger(spark, rows), "a", some).version == 1
    assert T.import_batch(store, ledger(spark, rows), "b", some).version == 1
