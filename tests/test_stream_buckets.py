"""Assets that share a key of the stream's state keep their own books."""

from __future__ import annotations

from coinfold.streaming import uk_stream as U
from tests.test_uk_stream import LEGS, batch, legs_of, rows_of


def test_all_assets_under_one_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "BUCKETS", 1)
    rows = legs_of(3, days=120)
    out = U.replayed(spark, spark.createDataFrame(rows, LEGS), str(tmp_path / "s"))
    assert len({r[1] for r in rows}) > 3 and rows_of(out, True) == batch(spark, rows)
