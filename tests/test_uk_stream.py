"""The stream of share matches against the batch engine: in one go, and in pieces with late legs."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from coinfold.plans import uk_cgt as UK
from coinfold.streaming import uk_stream as U

LEGS = "id string, asset string, timestamp timestamp, day date, kind string, quantity decimal(38,8), value decimal(38,12)"


def legs_of(seed, days=260, assets=4):
    rnd = random.Random(seed)
    out = []
    for i in range(600):
        at = datetime(2023, 1, 2, 12) + timedelta(days=rnd.randrange(days), minutes=rnd.randrange(600))
        asset = "HOT" if rnd.random() < 0.4 else f"A{rnd.randrange(assets)}"
        out.append((f"l{i:04d}", asset, at, at.date(), rnd.choice("ADD" if asset == "A0" else "AAD"), Decimal(rnd.randrange(1, 900)) / 7 // Decimal("1e-8") * Decimal("1e-8"), Decimal(rnd.randrange(1, 10**6)) / 100))
    return sorted(out, key=lambda r: r[2])


def rows_of(df, final):
    got = df.where(f"is_final = {final}").collect()
    return sorted((r.asset, r.match_type, r.day, r.disposal_id, r.acquisition_id or "", r.quantity, r.proceeds, r.cost) for r in got)


def batch(spark, rows):
    engine = UK.uk_engine(spark.createDataFrame(rows, LEGS)).where("row_kind = 'match'").collect()
    return sorted((r.asset, r.match_type, r.day, r.disposal_id, r.acquisition_id or "", r.quantity, r.proceeds, r.cost) for r in engine)


def test_replayed_stream_equals_the_batch_engine(spark, tmp_path):
    rows = legs_of(1)
    out = U.replayed(spark, spark.createDataFrame(rows, LEGS).repartition(5), str(tmp_path / "s"))
    want = batch(spark, rows)
    assert {"same_day", "thirty_day", "section_104", "unmatched"} <= {r[1] for r in want}
    assert rows_of(out, True) == want
    early = out.where("not is_final").collect()
    assert early and {r.match_type for r in early} <= {"section_104", "unmatched"} and {r.disposal_id for r in early} <= {r[3] for r in want}


def test_stream_in_pieces_settles_as_time_goes_on(spark, tmp_path):
    rows = legs_of(2, days=150, assets=1)
    folder, step = str(tmp_path / "in"), 60
    one = spark.newSession()
    one.conf.set("spark.sql.streaming.stateStore.providerClass", U.STATE_STORE)
    pieces = [rows[i : i + step] for i in range(0, len(rows), step)]
    for a, b in zip(pieces, pieces[1:]):  # some legs come a piece later, within the delay
        if (b[0][2] - a[-1][2]) < timedelta(days=1):
            b.append(a.pop())
    end = (rows[-1][2] + timedelta(days=400))
    pieces += [[("end", "", end, end.date(), "A", Decimal(1), Decimal(0))], [("end2", "", end, end.date(), "A", Decimal(1), Decimal(0))]]
    seen = []
    for piece in pieces:
        spark.createDataFrame(piece, LEGS).coalesce(1).write.mode("append").parquet(folder)
        q = U.share_matches(one.readStream.schema(LEGS).parquet(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(len(rows_of(spark.read.schema(U.ROWS).parquet(f"{tmp_path}/out"), True)))
    assert rows_of(spark.read.schema(U.ROWS).parquet(f"{tmp_path}/out"), True) == batch(spark, rows)
    assert 0 < seen[4] < seen[7] < seen[-1] and seen == sorted(seen)


def test_book_survives_its_text_form():
    book = U.Book("X", None)
    a = {"q": Decimal("3"), "left": Decimal("3"), "value": Decimal("30"), "id": "a"}
    d = {"q": Decimal("2"), "left": Decimal("2"), "value": Decimal("50"), "id": "d"}
    book.close(10, a, None)
    book.close(12, None, d)
    book.settle(41)
    again = U.Book("X", book.text())
    assert again.due() == 42 and [x[0] for x in again.days] == [12] and again.quantity == 3
    again.settle(42)
    assert again.rows == [("X", "section_104", date(1970, 1, 13), "d", None, Decimal(2), Decimal(50), Decimal(20), True)] and again.due() is None
