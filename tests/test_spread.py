"""Group aggregates and running sums against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from coinfold.functions import spread
from coinfold.functions.lineage import checkpoint_dir, clear_stored, stored
from coinfold.functions.spread import attach, running


def test_attach_and_running(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.randint(0, 9)) for i in range(300)] + [(None, 999, 1)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    monkeypatch.setattr(spread, "HOT_GROUPS", 3)  # one hot group, two others
    got = {r.i: (r.least, r.n) for r in attach(df, ["k"], least=F.min("v"), n=F.count("*")).collect()}
    assert got == {i: (min(v for q, _, v in rows if q == k), sum(q == k for q, _, _ in rows)) for k, i, _ in rows if k is not None}
    want, total = {}, 0
    for k, i, v in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = total
        total += v
    assert {r.i: r.before for r in running(df, [F.col("v"), F.col("i")], before=F.col("v")).collect()} == want
    assert attach(df.limit(0), ["k"], n=F.count("*")).count() == 0 and running(df.limit(0), [F.col("i")], before=F.col("v")).count() == 0


def test_stored_tables_can_be_cleared(spark):
    df = stored(spark.range(5).toDF("x"))
    assert df.count() == 5 and clear_stored(spark) >= 1


@pytest.mark.parametrize("name", ["yarn", "local-cluster[3,2,3000]", "spark://host:7077"])
def test_no_folder_of_a_machine_on_a_cluster(name):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = name

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
