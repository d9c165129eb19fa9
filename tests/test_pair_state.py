"""What the pair stream keeps."""

from __future__ import annotations

from coinfold.sources.testdata import LEDGER
from coinfold.streaming import pair_stream as PS


def test_the_state_holds_legs_and_not_candidates(spark, tmp_path):
    one = spark.newSession()
    rows = spark.createDataFrame([], LEDGER)
    rows.write.parquet(f"{tmp_path}/legs")
    c = PS.streamed_pairs(one.readStream.schema(rows.schema).parquet(f"{tmp_path}/legs"), 24)
    assert "Join" not in c._jdf.queryExecution().analyzed().toString()
