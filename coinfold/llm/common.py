"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir, drop_stored, stored, sweep
from ..functions.lineage import cut as _cut
from ..functions.spread import attach, give, running

__all__ = ["attach", "checkpoint_dir", "connected_components", "cut", "drop_stored", "give", "held_out", "labelled_sample", "partitions", "running", "slices", "stored", "table", "unused"]


EDGES_A_TASK = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, after which the shuffle files of what is cut may go at once: these operators run many small plans."""
    out = _cut(df)
    sweep(df.sparkSession)
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Shuffle partitions for `size` bytes: about `each` bytes in one, and not fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id's decimal text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, max_bytes: int, id_col: str, text_col: str, *more: str) -> pa.Table:
    """(id, y, text, *more), sorted by id: the labelled rows to fit on, at most `max_rows` rows and `max_bytes` bytes of text.

    Rows are taken in order of a hash of the id, outside the held-out quarter, as long as their bytes sum up to no more than the bound; a text
    of over a sixteenth of it is passed over. Null ids, labels and texts are left out. Of repeated labels the larger one counts, of
    repeated documents the one of least text. `more` columns that `docs` lacks are null.
    """
    cols = [F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string").alias(c) for c in more]
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.col(f"`{text_col}`").cast("string").alias("text"), *cols).alias("x")).where("id is not null and x.text is not null")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    order = [F.xxhash64("id"), "id"]
    pick = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(*order).limit(max_rows)
    # At most max_rows ids: the bound of this broadcast and of the window below.
    rows = stored(d.join(F.broadcast(pick), "id").groupBy("id", "y").agg(F.min("x").alias("x")))
    size = rows.select("id", F.octet_length("x.text").cast("long").alias("size")).where(F.col("size") <= max_bytes // 16)
    some = size.withColumn("sum", F.sum("size").over(Window.orderBy(*order))).where(F.col("sum") <= max_bytes).select("id")
    return rows.join(F.broadcast(some), "id").select("id", "y", "x.*").toArrow().sort_by("id")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds about `limit` bytes of text, a longer text whole and alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph of `edges` (src, dst): component is the least node that links reach.

    Alternating large-star and small-star steps. Each gives a node's least neighbour back to all its links by `attach`, so the links of
    a star's centre meet in no task; the number of rounds grows with the logarithm of the graph's size, and
    nothing is gathered on the driver. Null ends and loops are left out; nodes without an edge don't appear.
    """
    e = cut(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    state = [F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))]
    now = e.agg(*state).first()
    for _ in range(max_rounds):
        few = max(1, -(-now[0] // EDGES_A_TASK))  # a small graph takes few tasks; coalesce never makes more
        ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = e.coalesce(few).select(F.explode(ways).alias("x")).select("x.*")
        # `attach` names its input four times: each step is cut, so the driver compiles two small plans, the same in each round.
        large = cut(attach(both, ["src"], 2 * now[0], m=F.min("dst")).where("dst > src").select(F.col("dst").alias("src"), F.least("m", "src").alias("dst")).distinct().coalesce(few))
        small = attach(large, ["src"], 2 * now[0], m=F.min("dst")).select(
            F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("x")
        )
        e = cut(small.select("x.*").where("src <> dst").distinct())
        before, now = now, e.agg(*state).first()
        if now == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.select(F.col("dst").alias("node")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
