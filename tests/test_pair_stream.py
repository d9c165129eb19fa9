"""Pairs of a stream against those of the whole ledger."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from coinfold.operators import pairing as P
from coinfold.sources.testdata import LEDGER
from coinfold.streaming import pair_stream as PS

START = datetime(2024, 3, 1)


def ledger(spark, rows):
    names = [x.strip().split(" ")[0] for x in LEDGER.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LEDGER)


def legs_of(seed, n=500):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append({
            "id": f"l{i:04d}", "timestamp": START + timedelta(minutes=rnd.randrange(60 * 24 * 60)), "asset": "HOT" if rnd.random() < 0.5 else rnd.choice(["A", "B", None]), "source": rnd.choice(["x", "y", "z", None]),
            "transaction_type": "TRANSFER" if rnd.random() < 0.9 else "BUY", "transfer_direction": rnd.choice(["OUT", "IN"]), "amount": rnd.choice([1.0, 1.0, 0.995, 2.0, 1.9999, 5.0, 0.0]), "transfer_pair_id": "p" if rnd.random() < 0.05 else None,
        })
    return sorted(rows, key=lambda r: r["timestamp"])


def pairs(df):
    return sorted(map(tuple, df.select("asset", "out_id", "in_id", "pair_id").collect()))


def test_replayed_pairs_equal_those_of_the_ledger(spark, tmp_path):
    x = ledger(spark, legs_of(3))
    got, want = pairs(PS.replayed(x, str(tmp_path / "s"), 48)), pairs(P.transfer_pairs(x, 48))
    assert got == want and len(want) > 50


def test_pairs_come_as_the_watermark_passes(spark, tmp_path):
    rows = legs_of(4, 240)
    one = spark.newSession()
    one.conf.set("spark.sql.streaming.stateStore.providerClass", PS.STATE_STORE)
    end = rows[-1]["timestamp"] + timedelta(days=400)
    last = [{"id": f"end{w}{i}", "timestamp": end, "asset": f"end-{w}", "transaction_type": "TRANSFER", "transfer_direction": w, "amount": 1.0} for w in ("OUT", "IN") for i in range(2)]
    seen = []
    for piece in (rows[:90], rows[90:170], rows[170:], last[::2], last[1::2]):
        ledger(spark, piece).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = one.readStream.schema(LEDGER).parquet(str(tmp_path / "in"))
        q = PS.streamed_pairs(stream, 24).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(spark.read.schema(PS.PAIRS).parquet(f"{tmp_path}/out").count())
    assert pairs(spark.read.schema(PS.PAIRS).parquet(f"{tmp_path}/out")) == pairs(P.transfer_pairs(ledger(spark, rows), 24))
    assert 0 < seen[1] < seen[-1]


def test_join_key_has_a_time_bucket(spark, tmp_path):
    """Legs of one asset over years don't all meet in the state of one key."""
    one = spark.newSession()
    rows = spark.createDataFrame([], LEDGER)
    rows.write.parquet(f"{tmp_path}/legs")
    c = PS.streamed_candidates(one.readStream.schema(rows.schema).parquet(f"{tmp_path}/legs"), 24)
    join = next(line for line in c._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in line)
    assert "out_bucket" in join and "in_bucket" in join
