"""MinHash near-dedup by tensored banding.

A text is the set of its word shingles. `m` small collections of `r` minhashes each are computed once; a table exists for
each of the m(m-1)/2 pairs of collections and its key combines the two, so m*r minhashes serve as many tables as
r*m*(m-1) would without the tensoring. With m=14, r=3 a pair of similarity 0.8 is missed with probability 6e-4.

Work moves as narrow rows: identical sets collapse first; a collection value that only one set has can't be part of a
shared table key, so keys are formed only from shared values; a bucket sends one edge for each member, never all
pairs. These edges give candidate components. A component of up to `BLOCK` sets is settled in one task, which counts
all intersections in blocks of a 0/1 matrix and sends a spanning forest of the confirmed links. In a larger one, every set is first
confirmed against a few heads of the component; sets that are linked with the bulk need no comparison among themselves, and
only the others meet all, block by block. So every link between different components is found, whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import attach, connected_components, cut, slices, stored, table, unused

HOT_CENTRE = 2000
BLOCK = 384
HEADS = 8
COLUMNS = 8192


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = K.flat(batch.column("text"))
    buf = K.LOWER[buf]
    ws, we, doc = K.words(buf, off, K.NONSPACE)
    return K.distinct_sorted(*K.shingles(K.span_hash(K.prefix(buf), ws, we), doc, batch.num_rows, k))


def _set_keys(s: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """128 bits that name each set, whatever the order of its members."""
    return np.stack([np.add.reduceat(K.mix(s ^ K.mix(np.full(1, 2 * seed + i + 1, np.uint64))), at) for i in range(2)], 1)


def _signatures(k: int, m: int, r: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, m * r, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 2**63, m * r, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "text"):
            s, d = _sets(x, k)
            at = K.grouped_starts(d)
            n = np.bincount(d, minlength=x.num_rows).astype(np.int64)
            have = n > 0
            key = np.zeros((x.num_rows, 2), np.uint64)
            values = np.zeros((x.num_rows, m), np.uint64)
            if len(at):
                key[have] = _set_keys(s, at, seed)
                for c in range(m):
                    v = np.zeros(len(at), np.uint64)
                    for i in range(c * r, c * r + r):
                        v = K.mix(v + np.minimum.reduceat((s ^ b[i]) * a[i], at))
                    values[have, c] = v
            keys = pa.array([key[i].tobytes() if have[i] else None for i in range(x.num_rows)], pa.binary())
            offsets = np.arange(x.num_rows + 1, dtype=np.int32) * m
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(n), keys, lists], ["id", "n", "set_key", "colls"])

    return run


def _full_sets(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "text"):
            s, d = _sets(x, k)
            at = K.grouped_starts(d)
            raw = [s[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(s)), strict=True)]
            keys = [q.tobytes() for q in _set_keys(s, at, seed)] if len(at) else []
            yield pa.RecordBatch.from_arrays([x.column("id").take(pa.array(d[at])), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "set_key", "words"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            hit = np.zeros(x.num_rows, bool)
            left, right = x.column("left_set"), x.column("right_set")
            for i in range(x.num_rows):
                p, q = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q) or not len(p):
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                hit[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([x.column("src"), x.column("dst"), pa.array(hit)], ["src", "dst", "linked"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst, linked) for each pair of (src, salt, salts, dst): the set of src is repeated for each of its salts."""
    heads = pairs.select("src", "salts").distinct()
    left = sets.join(heads, sets.id == heads.src).select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("words").alias("left_set"))
    right = pairs.join(sets, pairs.dst == sets.id).select("src", "salt", "dst", F.col("words").alias("right_set"))
    return right.join(left, ["src", "salt"]).select("src", "dst", "left_set", "right_set").mapInArrow(_confirm(percent), "src long, dst long, linked boolean")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: a product of 0/1 matrices over the shared values."""
    size = np.array([len(x) for x in left] + [len(x) for x in right])
    values, col = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    n = len(left)
    both = (np.bincount(col[row < n], minlength=len(values)) > 0) & (np.bincount(col[row >= n], minlength=len(values)) > 0)
    place = np.cumsum(both) - 1
    use = both[col]
    row, col = row[use], place[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, len(right)), np.float32)
    for at in range(0, int(both.sum()), COLUMNS):
        i, j = np.searchsorted(col, [at, at + COLUMNS])
        x = np.zeros((len(size), COLUMNS), np.float32)
        x[row[i:j], col[i:j] - at] = 1
        out += x[:n] @ x[n:].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that links a-b reach, for each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block(percent: int):
    def run(t: pa.Table) -> pa.Table:
        o = np.argsort(t.column("id").to_numpy(), kind="stable")
        ids, role = t.column("id").to_numpy()[o], t.column("role").to_numpy()[o]
        raw = t.column("words").combine_chunks()
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in o]
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)  # role 2 stands on both sides
        n = np.array([len(x) for x in sets])
        if not len(left) or not len(right):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        k = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
        a, b = np.nonzero(100 * k >= percent * (n[left][:, None] + n[right][None, :] - k))
        a, b = left[a], right[b]
        # Equal ids on both sides are one node.
        node = np.searchsorted(ids, ids)
        root = _forest(node[a], node[b], len(ids))
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"src": ids[some], "dst": ids[root[some]]})

    return run


def _links(wanted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): confirmed links of candidate components (id, centre, k: their size), enough of them to connect what is connected.

    sets: id, words. Sizes travel with the narrow rows, and full sets are joined by id, so no component's sets meet in one task but those
    of a block.
    """
    whole = sets.join(wanted.where(F.col("k") <= BLOCK), "id").select("centre", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.lit(2).alias("role"), "words")
    member = cut(
        wanted.where(F.col("k") > BLOCK).withColumn("salts", F.ceil(F.col("k") / HOT_CENTRE).cast("int"))
        .withColumns({"salt": F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), "slot": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(HEADS))})
    )
    known = None
    if not member.isEmpty():
        heads = member.groupBy("centre", "slot").agg(F.min(F.struct(F.xxhash64("id", F.lit(1)), F.col("id").alias("head"))).alias("h"), F.first("salts").alias("salts"))
        heads = heads.select("centre", "h.head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        pairs = cut(member.join(heads, ["centre", "salt"]).where("id <> head").select(F.col("head").alias("src"), "salt", "salts", F.col("id").alias("dst")))
        big = stored(sets.join(member.select("id"), "id"))
        known = cut(_verified(pairs, big, percent).where("linked").select("src", "dst"))
        comp = connected_components(known)
        own = cut(member.join(comp, F.col("id") == F.col("node"), "left").select("id", "centre", "k", "salt", F.coalesce("component", "id").alias("comp")))
        # The component's largest part, and how many members stay outside it: a row for each part, then one for each component.
        parts = own.groupBy("centre", "comp").agg(F.count("*").alias("n"), F.first("k").alias("k"))
        bulk = parts.groupBy("centre").agg(F.max(F.struct("n", "comp")).alias("b"), F.first("k").alias("k"))
        bulk = bulk.select("centre", F.col("b.comp").alias("bulk"), F.ceil((F.col("k") - F.col("b.n")) / BLOCK).cast("int").alias("ni"), F.ceil(F.col("k") / BLOCK).cast("int").alias("nj"), F.ceil(F.col("k") / HOT_CENTRE).cast("int").alias("salts")).where("ni > 0")
        bulk = bulk.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        own = own.join(bulk, ["centre", "salt"]).select("id", "centre", "ni", "nj", (F.col("comp") != F.col("bulk")).alias("loose"))
        rows = big.join(own, "id")
        left = rows.where("loose").select("centre", F.pmod(F.xxhash64("id"), F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "id", F.lit(0).alias("role"), "words")
        right = rows.select("centre", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("nj")).cast("int").alias("j"), "id", F.lit(1).alias("role"), "words")
        whole = whole.unionByName(left).unionByName(right)
    found = whole.groupBy("centre", "i", "j").applyInArrow(_block(percent), "src long, dst long")
    return found if known is None else found.unionByName(known)


def minhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, m: int = 14, r: int = 3, seed: int = 7
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of `docs`.

    Words are runs of non-space after lower-casing A-Z; a text of fewer than `words` words is one shingle; null and empty
    texts have n_shingles 0 and are alone. Equal ids count as one document for linking, that of the least set key; rows with a null id come
    back with component_id null and kept true. An empty table gives no rows; other columns are ignored whatever their names.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sig = cut(src.mapInArrow(_signatures(words, m, r, seed), "id long, n long, set_key binary, colls array<long>"))
    # Of rows that repeat an id the one of least set key counts. Exact copies collapse to the least id.
    one = sig.where("id is not null and n > 0").groupBy("id").agg(F.min(F.struct("set_key", "colls")).alias("x")).select("id", "x.*")
    total = sig.count()
    # What `attach` is given is cut: it names its input four times, and nested calls would give the driver one plan of hundreds of steps.
    reps = cut(one.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("colls").alias("colls")))
    of = cut(attach(one.select("id", "set_key"), ["set_key"], total, rep=F.min("id")).select("id", "rep"))
    values = reps.select("rep", F.posexplode("colls").alias("c", "h"))
    shared = attach(values, ["c", "h"], m * total, k=F.count("*")).where("k > 1")
    mine = cut(shared.groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("c", "h"))).alias("v")).where(F.size("v") > 1))
    pair = "flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> xxhash64(x.c, x.h, y.c, y.h))))"
    keys = mine.select("rep", F.explode(F.expr(pair)).alias("key"))
    bucket = attach(keys, ["key"], m * (m - 1) // 2 * total, centre=F.min("rep"), k=F.count("*")).where("k > 1")
    coarse = cut(connected_components(bucket.select(F.col("rep").alias("src"), F.col("centre").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("centre")))
    wanted = cut(attach(coarse, ["centre"], k=F.count("*")))
    sets = src.where("id is not null").join(wanted.select("id"), "id").mapInArrow(_full_sets(words, seed), "id long, set_key binary, words binary")
    sets = stored(sets.groupBy("id").agg(F.min(F.struct("set_key", "words"))["words"].alias("words")))
    comp = connected_components(_links(wanted, sets, percent))
    of = of.join(comp, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("found"))
    out = sig.select("id", "n").join(of, "id", "left")
    component = F.coalesce("found", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), words=4)


#: Exact links of all pairs that share a shingle, then components by repeated joins.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) c ON c.x = d.doc_id
"""


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """`docs` with one row of each group of near copies: the one of least id, null ids last, then of least text.

    Rows get a key that is written with them and are compared by it, so repeated rows and rows with a null id are copies like any
    others. Rows without words are copies of nothing and stay. An empty table gives an empty one; columns stay as they are.
    """
    row, gone = unused(docs, "row_of_dedup"), unused(docs, "gone_of_dedup")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = minhash_dedup(keyed, row, text_col, **kw).select(F.col("doc_id").alias("row"), "component_id")
    ident = keyed.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))
    order = F.struct(F.col("id").isNull(), "id", "tie", "row")
    group = attach(cut(found.join(ident, "row")), ["component_id"], first=F.min(order))
    lost = group.where(F.col("first.row") != F.col("row")).select(F.col("row").alias(gone))
    return keyed.join(lost, F.col(row) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
