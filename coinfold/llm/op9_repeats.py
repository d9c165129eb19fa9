"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first `depth` bytes, by most-significant-digit passes: each pass deals the suffixes that are still
in a group of two or more by their next digit, and groups that are left whole at the end are exactly the repeated windows.
Order inside the key is free as long as it is the same for all, so the first digit is the one that says most: the anchor, the
least-hash k-byte string inside the window, leftmost on ties. Equal windows have equal anchors at equal offsets, and
neighbouring windows share theirs, so the first pass moves one narrow row per stretch of windows instead of one per
window. Stretches that are equal as a whole are settled there. The remaining passes run over digits of `digit` bytes inside buckets
of anchors.

Hot anchors (a line in a third of all texts) never meet in one task: an anchor that is frequent in a slice of the input is flagged, and
the windows of flagged or large anchor groups are dealt by a 128-bit hash of their whole key instead. What is dealt by a whole
key is collapsed in each task before it moves, so even a window in every text sends one row for each task. The number of buckets
follows the bytes of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import partitions, slices, stored, table

U = np.uint64
ANCHOR = 24
DIGIT = 20
SLICE_HOT = 8
GROUP_HOT = 4096
HELD = 1 << 19
POSITION_BITS = 31
STRETCH = "id long, c int, s int, e int, h1 long, kind int"
REMOVED, COLD, HOT = 0, 1, 2


def _sliding_min(y: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima of blocks in both directions."""
    n = len(y)
    z = np.full(-(-n // w) * w, U(2**64 - 1), U)
    z[:n] = y
    z = z.reshape(-1, w)
    ahead = np.minimum.accumulate(z, 1).ravel()
    back = np.minimum.accumulate(z[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(buf: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of window starts inside a text that share an anchor: first and last start, text number, anchor hash, hash of all bytes."""
    z = np.zeros(0, np.int64)
    if len(buf) < depth:
        return z, z, z, z.astype(U), z.astype(U)
    h = K.prefix(buf)
    at = np.arange(len(buf) - ANCHOR + 1)
    y = K.span_hash(h, at, at + ANCHOR)
    low = U((1 << POSITION_BITS) - 1)
    anchor = (_sliding_min((y & ~low) | at.astype(U), depth - ANCHOR + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    ok = start + depth <= off[1:][doc]
    start, anchor, doc = start[ok], anchor[ok], doc[ok]
    if not len(start):
        return z, z, z, z.astype(U), z.astype(U)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(start) - 1]])
    s, e, a = start[first], start[last], anchor[first]
    return s, e, doc[first], y[a], K.mix(K.span_hash(h, s, e + depth) + (a - s).astype(U))


def _later(keys: tuple[np.ndarray, ...], ident: np.ndarray, at: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then id, start and text of the id; for each in that order whether its group has an earlier member, and where groups begin."""
    o = np.lexsort((*(() if c is None else (c,)), at, ident, *reversed(keys)))
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(o) else o
    later = (ident[o] != ident[o][head]) | (at[o] != at[o][head])
    return o, later, new


def _same(c: np.ndarray, later: np.ndarray, new: np.ndarray) -> np.ndarray:
    """In the order of `_later`, rows that repeat the one before: the same text of an id, the same start."""
    out = ~later & ~new
    out[1:] &= c[1:] == c[:-1]
    return out


COLUMNS = (("h1", U), ("sh", U), ("id", np.int64), ("s", np.int32), ("n", np.int32), ("c", np.int32))


def _packed(kind: int, bucket: np.ndarray, cols: tuple[np.ndarray, ...], extra: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """One blob for each bucket: the number of rows, then the columns one after another; ids as differences."""
    if not len(bucket):
        return
    o = np.lexsort((cols[3], cols[2], bucket))
    cols = tuple(c[o] for c in cols)
    begin = K.grouped_starts(bucket[o])
    for a, b in zip(begin, np.append(begin[1:], len(o)), strict=True):
        parts = [np.int64(b - a).tobytes()]
        for (name, t), c in zip(COLUMNS, cols, strict=True):
            v = np.diff(c[a:b], prepend=0) if name == "id" else c[a:b]
            parts.append(v.astype(t).tobytes())
        if extra is not None:
            buf, depth = extra
            parts += [buf[i:j].tobytes() for i, j in zip(*(x[o][a:b] for x in depth), strict=True)]
        yield kind, int(bucket[o[a]]), b"".join(parts)


def _unpacked(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    cols: list[list[np.ndarray]] = [[] for _ in COLUMNS]
    rest = []
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for i, (name, t) in enumerate(COLUMNS):
            v = np.frombuffer(b, t, n, at)
            cols[i].append(np.cumsum(v) if name == "id" else v)
            at += n * np.dtype(t).itemsize
        rest.append(np.frombuffer(b, np.uint8, offset=at))
    return [np.concatenate(c) if c else np.zeros(0, t) for c, (_, t) in zip(cols, COLUMNS, strict=True)], rest


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, b, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], ["kind", "bucket", "blob"])


def _ids(x: pa.RecordBatch, name: str = "id") -> np.ndarray:
    return x.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


class _Collapsed:
    """Rows held back in a task, of which only the first of each key is sent on; at most a bounded number is held.

    Columns are those of COLUMNS; `keys` tells which of them make the key, `deal` which one names the bucket.
    """

    def __init__(self, nb: int, keys: tuple[int, ...], deal: int, held: int):
        self.nb, self.keys, self.deal, self.held = nb, keys, deal, held
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *cols: np.ndarray) -> list:
        """Packed rows that are due: of rows that came after an equal one, and of all if too many differ."""
        self.parts.append(cols)
        self.n += len(cols[0])
        return self.due() if self.n > 2 * self.held else []

    def due(self, last: bool = False) -> list:
        if not self.parts:
            return []
        cols = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        o, later, new = _later(tuple(cols[k] for k in self.keys), cols[2], cols[3], cols[5])
        gone = o[later]
        out = list(_removed(cols[2][gone], cols[3][gone], cols[4][gone], cols[5][gone], self.nb))
        o = o[~later & ~_same(cols[5][o], later, new)]  # an equal row of the same text and start is the same occurrence
        cols = tuple(c[o] for c in cols)
        self.parts, self.n = [cols], len(o)
        if last or len(o) > self.held:
            out += _packed(HOT, (cols[self.deal] % U(self.nb)).astype(np.int64), cols)
            self.parts, self.n = [], 0
        return out


def _removed(ident: np.ndarray, s: np.ndarray, n: np.ndarray, c: np.ndarray, nb: int) -> Iterator[tuple[int, int, bytes]]:
    zero = np.zeros(len(ident), U)
    return _packed(REMOVED, (ident % nb).astype(np.int64), (zero, zero, ident, s, n, c))


def _anchors(depth: int, nb: int, slice_hot: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = _Collapsed(nb, (0, 1), 1, held)
        told: set[int] = set()
        for x in slices(batches, "text", 2 << 20):
            buf, off = K.flat(x.column("text"))
            s, e, doc, h1, sh = stretches(buf, off, depth)
            ident, c, n = _ids(x)[doc], _ids(x, "c")[doc], e - s
            s = s - off[doc]
            o, later, _ = _later((sh,), ident, s)
            out = []
            gone = o[later]
            out += _removed(ident[gone], s[gone], n[gone], c[gone], nb)
            o = o[~later]
            h1, sh, ident, s, n, c = h1[o], sh[o], ident[o], s[o], n[o], c[o]
            _, inv, count = np.unique(h1, return_inverse=True, return_counts=True)
            hot = count[inv] > slice_hot
            out += _packed(COLD, (h1[~hot] % U(nb)).astype(np.int64), tuple(v[~hot] for v in (h1, sh, ident, s, n, c)))
            out += hold.add(*(v[hot] for v in (h1, sh, ident, s, n, c)))
            # A mark tells the anchor's bucket, once in a task, that it is hot: a row of length -1.
            marks = np.array([m for m in np.unique(h1[hot]).tolist() if m not in told], U)
            told.update(marks.tolist())
            if len(told) > held:
                told.clear()
            zero = np.zeros(len(marks), np.int64)
            out += _packed(COLD, (marks % U(nb)).astype(np.int64), (marks, zero.astype(U), zero, zero, zero - 1, zero))
            yield _rows(out)
        yield _rows(hold.due(True))

    return run


def _first_pass(group_hot: int):
    """Deals a bucket by anchor: single anchors leave, equal stretches are settled, the rest goes on as cold or hot."""

    def run(t: pa.Table) -> pa.Table:
        return _dealt(t, group_hot)

    return run


def _dealt(t: pa.Table, group_hot: int) -> pa.Table:
    kind = t.column("kind")[0].as_py()
    (h1, sh, ident, s, n, c), _ = _unpacked(t.column("blob").to_pylist())
    out = np.full(len(h1), REMOVED)
    if kind != REMOVED:
        mark = n < 0
        marked = np.unique(h1[mark])
        h1, sh, ident, s, n, c = (v[~mark] for v in (h1, sh, ident, s, n, c))
        o, later, new = _later((h1, sh), ident, s, c)
        h1, sh, ident, s, n, c = (v[o] for v in (h1, sh, ident, s, n, c))
        _, inv = np.unique(h1, return_inverse=True)
        classes = np.bincount(inv, weights=new)[inv] if len(inv) else np.zeros(0)
        hot = np.isin(h1, marked) | (classes > group_hot) | (kind == HOT)
        out = np.where(later, REMOVED, np.where(hot, HOT, np.where(classes > 1, COLD, -1)))
        # A repeated row of the same text and start is no other occurrence; it goes with its first row.
        out[_same(c, later, new)] = -1
    ok = out >= 0
    return pa.table({"id": ident[ok], "c": c[ok].astype(np.int32), "s": s[ok], "e": (s + n)[ok], "h1": h1[ok].view(np.int64), "kind": out[ok].astype(np.int32)})


def _windows(depth: int, nb: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = _Collapsed(nb, (0, 1), 0, held)
        for x in slices(batches, "text", 2 << 20):
            buf, off = K.flat(x.column("text"))
            lists = x.column("runs")
            doc = np.repeat(np.arange(x.num_rows), np.diff(lists.offsets.to_numpy()))
            f = lists.flatten()
            s, e, h1, kind = (f.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ident, copy = _ids(x)[doc], _ids(x, "c")[doc]
            out = []
            cold = kind == COLD
            b = (h1.view(U) % U(nb)).astype(np.int64)
            begin, end = off[doc] + s, off[doc] + e + depth
            if cold.any():
                out += _packed(COLD, b[cold], (h1.view(U)[cold], h1.view(U)[cold], ident[cold], s[cold], (e - s)[cold], copy[cold]), (buf, (begin[cold], end[cold])))
            if (~cold).any():
                n = (e - s + 1)[~cold].astype(np.int64)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s[~cold].astype(np.int64), n)
                who, d, c = (np.repeat(v[~cold], n) for v in (ident, doc, copy))
                h = K.prefix(buf)
                p = off[d] + at
                one = K.span_hash(h, p, p + depth)
                two = K.mix(K.span_hash(h, p, p + DIGIT) + K.span_hash(h, p + DIGIT, p + depth) * U(0x9E3779B97F4A7C15))
                out += hold.add(one, two, who, at, np.zeros(len(one), np.int64), c)
            yield _rows(out)
        yield _rows(hold.due(True))

    return run


def radix_groups(buf: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(window numbers, group) of the windows that are repeated inside their group: one pass for each digit, single ones leave."""
    h = K.prefix(buf)
    here = np.arange(len(start))
    for d in range(0, depth, DIGIT):
        p = start[here] + d
        digit = K.span_hash(h, p, p + min(DIGIT, depth - d))
        o = np.lexsort((digit, group))
        new = np.ones(len(o), bool)
        new[1:] = (digit[o][1:] != digit[o][:-1]) | (group[o][1:] != group[o][:-1])
        number = np.cumsum(new) - 1
        more = np.bincount(number)[number] > 1 if len(o) else new
        here, group = here[o][more], number[more]
    return here, group


def _last_passes(depth: int):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        blobs = t.column("blob").to_pylist()
        (h1, sh, ident, s, n, c), rest = _unpacked(blobs)
        found = []
        if kind == REMOVED:
            found = [(ident, c, s)]
        elif kind == HOT:
            o, later, _ = _later((h1, sh), ident, s)
            found = [tuple(v[o[later]] for v in (ident, c, s))]
        else:
            buf = np.concatenate(rest)
            size = n.astype(np.int64) + depth
            begin = np.cumsum(size) - size
            o = np.argsort(h1, kind="stable")
            groups = K.grouped_starts(h1[o])
            total = np.cumsum((n + 1)[o].astype(np.int64))
            a = 0
            while a < len(o):  # whole anchor groups, about a million windows at a time
                base = total[a - 1] if a else 0
                b = int(np.searchsorted(total, base + (1 << 20), "right"))
                b = len(o) if b >= len(o) else max(b, a + 1)
                g = int(np.searchsorted(groups, b, "left"))
                b = int(groups[g]) if g < len(groups) else len(o)
                some = o[a:b]
                count = (n[some] + 1).astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                where, key = np.repeat(begin[some], count) + step, np.repeat(h1[some], count)
                here, group = radix_groups(buf, where, np.unique(key, return_inverse=True)[1], depth)
                who, copy, at = np.repeat(ident[some], count)[here], np.repeat(c[some], count)[here], (np.repeat(s[some], count) + step)[here]
                p, later, _ = _later((group,), who, at)
                found.append(tuple(v[p[later]] for v in (who, copy, at)))
                a = b
        who, copy, at = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(3))
        o = np.lexsort((at, copy, who))
        who, copy, at = who[o], copy[o], at[o]
        cut = np.flatnonzero((who[1:] != who[:-1]) | (copy[1:] != copy[:-1]) | (at[1:] > at[:-1] + 1)) if len(who) else who
        first, last = (np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(who) - 1]])) if len(who) else (who, who)
        return pa.table({"id": who[first], "c": copy[first].astype(np.int32), "s": at[first].astype(np.int32), "e": at[last].astype(np.int32)})

    return run


def numbered_texts(src: DataFrame) -> DataFrame:
    """(id, text, c): c tells the different texts of an id apart; 0 where it has one, -1 for null texts.

    The rows of an id are counted by a hash of their texts; a table in which every id has one text, as a rule, is not joined with anything.
    """
    mark = F.md5(F.col("text").cast("binary"))
    many = stored(src.where("id is not null and text is not null").select("id", mark.alias("h")).groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id"))
    if many.isEmpty():
        return src.withColumn("c", F.when(F.col("text").isNull(), -1).otherwise(0))
    texts = src.where("text is not null").select("id", mark.alias("h")).join(many, "id", "left_semi").distinct()
    rank = texts.withColumn("c", F.row_number().over(Window.partitionBy("id").orderBy("h")) - 1)
    return src.withColumn("h", mark).join(rank, ["id", "h"], "left").select("id", "text", F.when(F.col("text").isNull(), -1).otherwise(F.coalesce("c", F.lit(0))).alias("c"))


def repeated_runs(docs: DataFrame, depth: int = 100, slice_hot: int = SLICE_HOT, group_hot: int = GROUP_HOT, held: int = HELD) -> DataFrame:
    """(id, c, s, e): runs of window starts, in bytes, at which a window begins that also begins earlier. docs: id long, text string, c (`numbered_texts`).

    slice_hot: how often an anchor stands in a slice to be hot; group_hot: how many different stretches of an anchor go by whole
    windows; held: how many rows a task holds back to collapse them. They change the way, not the result.
    """
    src = docs.where("id is not null and text is not null")
    spark = docs.sparkSession
    size = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = partitions(spark, size)
    nb = 4 * parts  # about 16 MB of text in each

    def dealt(df: DataFrame):
        more = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
        return (df.repartition(parts, "kind", "bucket") if more else df).groupBy("kind", "bucket")

    blob = "kind int, bucket int, blob binary"
    first = stored(dealt(src.mapInArrow(_anchors(depth, nb, slice_hot, held), blob)).applyInArrow(_first_pass(group_hot), STRETCH))
    open_ = first.where(f"kind <> {REMOVED}").groupBy("id", "c").agg(F.collect_list(F.struct("s", "e", "h1", "kind")).alias("runs"))
    rest = src.join(open_, ["id", "c"]).select("id", "c", "text", "runs").mapInArrow(_windows(depth, nb, held), blob)
    rest = stored(dealt(rest).applyInArrow(_last_passes(depth), "id long, c int, s int, e int"))
    return first.where(f"kind = {REMOVED}").select("id", "c", "s", "e").unionByName(rest)


def _removal(depth: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "text"):
            raw = x.column("text").cast(pa.binary()).to_pylist()
            lists = x.column("runs")
            n, removed, spans, digest, kept = [], [], [], [], []
            for i, b in enumerate(raw):
                b = b or b""
                gone = []
                if lists[i].is_valid and len(lists[i]):
                    f = lists[i].values
                    s, e = f.field(0).to_numpy(), f.field(1).to_numpy() + depth
                    o = np.argsort(s, kind="stable")
                    s, e = s[o], np.maximum.accumulate(e[o])
                    head = np.concatenate([[True], s[1:] > e[:-1]])
                    gone = list(zip(s[head].tolist(), e[np.append(np.flatnonzero(head)[1:] - 1, len(e) - 1)].tolist(), strict=True))
                parts, at = [], 0
                for a, c in gone:
                    parts.append(b[at:a])
                    at = c
                parts.append(b[at:])
                rest = b"".join(parts)
                n.append(len(b))
                removed.append(len(b) - len(rest))
                spans.append([{"start": a, "end": c} for a, c in gone])
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if texts else None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            cols = [x.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digest, pa.string())]
            names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * texts, names + ["kept"] * texts)

    return run


def remove_repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, **deal: int) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256[, kept]): one row per row of `docs`; spans are byte runs removed, end exclusive.

    Null and empty texts have n_bytes 0. Rows with a null id lose nothing and are no earlier occurrence. Rows of the same id
    and text are one document: they lose the same bytes. Other texts of that id are judged for themselves: a string is earlier under a smaller id
    or at an earlier start, so the same start in two texts of an id is no repetition. `kept` holds the bytes left, which need
    not end between characters. An empty table gives no rows; other columns are ignored whatever their names. `deal`: settings of `repeated_runs`.
    """
    if depth < 2 * ANCHOR:
        raise ValueError(f"depth below {2 * ANCHOR}")
    src = numbered_texts(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    runs = repeated_runs(src, depth, **deal).groupBy("id", "c").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    schema = "id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string" + ", kept binary" * texts
    return src.join(runs, ["id", "c"], "left").select("id", "text", "runs").mapInArrow(_removal(depth, texts), schema)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
