"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word numbers of a block of items (bounded by a number of words), and every text of the corpus streams
through it: the longest match that ends at each word is tracked, and words inside a match of window length are hit. Words outside
the block's alphabet, and word pairs that no item has, end a match, so only runs long enough to hold a window are
stepped through; that skip loses nothing. Blocks go to the executors as broadcasts of that bounded size, and a worker builds a
block's automaton once. A benchmark of any size is worked off block by block, each over all texts; the driver and a task hold one
block at a time, and what the blocks found is merged by row.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import slices, stored, table, unused

BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; states know the items that hold their longest word sequence."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.items: list[set[int]] = [set()]
        self.short: list[set[int]] = [set()]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None and self.len[q] == self.len[last] + 1:
            return q
        if q is not None:
            return self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        k = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def build(self, items: list[list[int]]) -> SuffixAutomaton:
        for words in items:
            last = 0
            for c in words:
                last = self._extend(last, c)
        n = len(self.len)
        self.items, self.short = [set() for _ in range(n)], [set() for _ in range(n)]
        for number, words in enumerate(items):
            s, l = 0, 0
            for c in words:
                s, l = self.next[s][c], l + 1
                if l >= self.window:
                    t = s
                    while self.len[self.link[t]] >= self.window:
                        t = self.link[t]
                    self.items[t].add(number)
            if 0 < l < self.window:
                self.short[s].add(number)
        # Of each state, the nearest suffix state (itself included) at which a short item ends.
        self.ends = [-1] * n
        for s in sorted(range(1, n), key=self.len.__getitem__):
            self.ends[s] = s if self.short[s] else self.ends[self.link[s]]
        return self

    def scan(self, words: list[int], lengths: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches of a run of word numbers, and the items that occur; lengths: of the short items."""
        nxt, link, size, window = self.next, self.link, self.len, self.window
        s = l = 0
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, c in enumerate(words):
            while s and c not in nxt[s]:
                s = link[s]
                l = size[s]
            t = nxt[s].get(c)
            if t is None:
                continue
            s, l = t, l + 1
            if l >= window:
                t = s
                while size[link[t]] >= window:
                    t = link[t]
                found |= self.items[t]
                hits.append((i - window + 1, i + 1))
            e = self.ends[s]
            while e > 0:
                short = [x for x in self.short[e] if lengths[x] <= l]
                if short:
                    found.update(short)
                    hits.append((i + 1 - max(lengths[x] for x in short), i + 1))
                e = self.ends[link[e]]
        return hits, found


def item_words(text: str | None) -> list[bytes]:
    buf, off = K.flat(pa.array([text or ""]))
    buf = K.LOWER[buf]
    ws, we, _ = K.words(buf, off, K.ALNUM)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(ws, we, strict=True)]


def _blocks(items: Iterator[tuple[str, str]], limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, n = [], 0
    for item_id, text in items:
        w = item_words(text)
        if not w:
            continue
        if block and n + len(w) > limit:
            yield block
            block, n = [], 0
        block.append((item_id, w))
        n += len(w)
    if block:
        yield block


class Scanner:
    """Finds the hit words of texts for one block of items."""

    def __init__(self, block: list[tuple[str, list[bytes]]], window: int):
        vocab: dict[bytes, int] = {}
        numbers = [[vocab.setdefault(w, len(vocab)) for w in ws] for _, ws in block]
        ends = np.cumsum([len(w) for w in vocab])
        buf = np.frombuffer(b"".join(vocab), np.uint8)
        hashes = K.span_hash(K.prefix(buf), ends - np.array([len(w) for w in vocab]), ends)
        order = np.argsort(hashes)
        self.size = len(vocab)
        self.hashes, self.number_of = hashes[order], order.astype(np.int64)
        self.pairs = np.unique(np.array([a * len(vocab) + b for ws in numbers for a, b in zip(ws, ws[1:])] or [-1], np.int64))
        self.lengths = [len(x) for x in numbers]
        self.shortest = min(window, *self.lengths) if len(numbers) > 1 else min(window, self.lengths[0])
        self.names = [x for x, _ in block]
        self.machine = SuffixAutomaton(window).build(numbers)

    def runs(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and begin and end of the runs of words that may hold a window."""
        p = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ids = np.where(self.hashes[p] == h, self.number_of[p], -1)
        joined = np.zeros(len(ids), bool)  # to the word before, by a pair that some item has
        both = (ids[1:] >= 0) & (ids[:-1] >= 0) & (doc[1:] == doc[:-1])
        code = ids[:-1] * self.size + ids[1:]
        q = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        joined[1:] = both & (self.pairs[q] == code)
        begin = np.flatnonzero((ids >= 0) & ~joined)
        stop = np.flatnonzero(~joined)
        end = np.append(stop, len(ids))[np.searchsorted(stop, begin, "right")]
        keep = end - begin >= self.shortest
        return ids, begin[keep], end[keep]

    def scan(self, texts: pa.Array) -> list[tuple[int, list[int], list[str], list[dict[str, int]]]]:
        """For each text its number of words, hit words, items and hit stretches: first and last word, begin and end in bytes."""
        buf, off = K.flat(texts)
        buf = K.LOWER[buf]
        ws, we, doc = K.words(buf, off, K.ALNUM)
        n_words = np.bincount(doc, minlength=len(texts)).tolist()
        out = [(n, [], [], []) for n in n_words]
        if not len(ws):
            return out
        ids, begin, end = self.runs(K.span_hash(K.prefix(buf), ws, we), doc)
        hit = np.zeros(len(ws) + 1, np.int32)
        found: dict[int, set[int]] = {}
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            hits, items = self.machine.scan(ids[a:b].tolist(), self.lengths)
            for i, j in hits:
                hit[a + i] += 1
                hit[a + j] -= 1
            if items:
                found.setdefault(int(doc[a]), set()).update(items)
        covered = np.cumsum(hit[:-1]) > 0
        base = np.concatenate([[0], np.cumsum(n_words)])
        for d in np.unique(doc[covered]).tolist():
            m = np.flatnonzero(covered[base[d] : base[d + 1]])
            g = np.flatnonzero(np.diff(m) > 1)
            first, last = np.concatenate([[m[0]], m[g + 1]]), np.concatenate([m[g], [m[-1]]])
            spans = [{"first": int(i), "last": int(j), "start": int(ws[base[d] + i] - off[d]), "end": int(we[base[d] + j] - off[d])} for i, j in zip(first, last, strict=True)]
            out[d] = (n_words[d], m.tolist(), sorted({self.names[i] for i in found.get(d, ())}), spans)
        return out


_held: dict[tuple[str, int], Scanner] = {}


def _scanner(block: Broadcast, window: int) -> Scanner:
    """The block's scanner, built once in a worker, which holds one at a time."""
    name, items = block.value
    if (name, window) not in _held:
        _held.clear()
        _held[name, window] = Scanner(items, window)
    return _held[name, window]


SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))


def _found(block: Broadcast, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(block, window)
        for x in slices(batches, "text"):
            n, hit, items, spans = zip(*scanner.scan(x.column("text")), strict=True)
            yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], ["id", "n_words", "hit_words", "items", "spans"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts what several blocks found in a row together: words and items once each, stretches that touch as one."""
    for x in batches:
        hit, items, spans = [], [], []
        for h, i, s in zip(*(x.column(c).to_pylist() for c in ("hit_words", "items", "spans")), strict=True):
            hit.append(sorted(set(itertools.chain(*h))))
            items.append(sorted(set(itertools.chain(*i))))
            merged: list[dict[str, int]] = []
            for p in sorted(itertools.chain(*s), key=lambda p: (p["first"], p["last"])):
                if merged and p["first"] <= merged[-1]["last"] + 1:
                    if p["last"] > merged[-1]["last"]:
                        merged[-1] |= {"last": p["last"], "end": p["end"]}
                else:
                    merged.append(dict(p))
            spans.append(merged)
        yield pa.RecordBatch.from_arrays([x.column("id"), x.column("n_words"), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], ["id", "n_words", "hit_words", "items", "spans"])


def _benchmark_blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Broadcast]:
    """Blocks of items, each as a broadcast; items stream past the driver, which holds one partition of them and one block."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    sc = benchmark.sparkSession.sparkContext
    for block in _blocks(((r.i, r.t) for r in items.toLocalIterator()), BLOCK_WORDS):
        yield sc.broadcast((uuid.uuid4().hex, block))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", spans: bool = False
) -> DataFrame:
    """(id, n_words, hit_words array<int>, items array<string>[, spans]): one row per row of `docs`.

    Null and empty texts have no words and no hits; items without words or with a null id never match; repeated
    items count once. Rows with a null or repeated id are rows of their own; an empty table gives no rows. With `spans`, hit stretches: first and
    last word, begin and end in bytes (end exclusive). Other columns are ignored whatever their names.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    fields = f"n_words long, hit_words array<int>, items array<string>, spans {SPANS}"
    blocks = _benchmark_blocks(benchmark, item_col, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        first = first or docs.sparkSession.sparkContext.broadcast(("none", [("", [b"\x00"])]))
        out = src.mapInArrow(_found(first, window), f"id {kind}, {fields}")
        return out if spans else out.drop("spans")
    # Rows get a key that is written with them: ids may repeat or be null. Of the blocks after the first only rows with hits matter.
    keyed = stored(src.select(F.struct(F.monotonically_increasing_id().alias("row"), "id").alias("id"), "text"))
    out = None
    for block in itertools.chain([first, second], blocks):
        part = keyed.mapInArrow(_found(block, window), f"id struct<row:bigint,id:{kind}>, {fields}")
        out = part if out is None else out.unionByName(part.where("size(hit_words) > 0"))
    lists = [F.collect_list(c).alias(c) for c in ("hit_words", "items", "spans")]  # a row has at most one of each block
    out = out.groupBy(F.col("id.row").alias("row")).agg(F.first("id.id").alias("id"), F.max("n_words").alias("n_words"), *lists).drop("row").mapInArrow(_joined, f"id {kind}, {fields}")
    return out if spans else out.drop("spans")


def _cut_out(text: str, spans: list[dict[str, int]]) -> str:
    raw, parts, at = text.encode(), [], 0
    for s in spans:
        parts.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """`docs` without the documents whose hit words exceed `max_share` of their words; from the others the hit stretches go.

    Columns stay as they are, texts without a hit byte for byte. A removed stretch leaves the bytes around it as they
    were; n_chars, if there is such a column, follows the new text. Null and empty texts and null ids are kept, repeated rows are each
    judged for themselves, an empty table or benchmark changes nothing. The id column may be missing.
    """
    blocks = _benchmark_blocks(benchmark, item_col, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    limit = float(max_share)

    def edit(x: pa.RecordBatch, found: list[tuple[int, int, list]]) -> pa.RecordBatch:
        """found: for each row the number of words, of hit words, and the hit stretches."""
        texts = x.column(text_col).to_pylist()
        texts = [_cut_out(t, s) if s else t for t, (_, _, s) in zip(texts, found, strict=True)]
        i = x.schema.get_field_index(text_col)
        return x.set_column(i, x.schema.field(i), pa.array(texts, x.schema.field(i).type)).filter(pa.array([h <= limit * n for n, h, _ in found]))

    if second is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(first, window)
            for x in slices(batches, text_col):
                yield edit(x, [(n, len(h), s) for n, h, _, s in scanner.scan(x.column(text_col))])

        out = docs.mapInArrow(run, docs.schema)
    else:
        row, hits = unused(docs, "row_of_scan"), unused(docs, "hits_of_scan")
        keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()))
        found = contamination(keyed, benchmark, window, row, text_col, item_col, item_text, True).where("size(hit_words) > 0")
        found = found.select(F.col("id").alias(row), F.struct("n_words", F.size("hit_words").alias("n_hit"), "spans").alias(hits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in slices(batches, text_col):
                marks = [(r["n_words"], r["n_hit"], r["spans"]) if r else (0, 0, []) for r in x.column(hits).to_pylist()]
                yield edit(x.drop_columns([row, hits]), marks)

        out = keyed.join(found, row, "left").select(row, *[F.col(f"`{c}`") for c in docs.columns], hits).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(f"`{text_col}`").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH norm AS (
  SELECT doc_id AS id, true AS is_doc, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT item_id, false, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
win AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda i: array_to_string(ws[i:i+9], ' '))) AS g
  FROM norm WHERE NOT is_doc AND len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT id AS doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, ws FROM norm, ks WHERE is_doc AND len(ws) >= k),
occ AS (SELECT doc_id, p, pos.k, win.item_id FROM pos JOIN win ON win.k = pos.k AND win.g = array_to_string(ws[p:p+pos.k-1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS w FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM occ GROUP BY 1)
SELECT id AS doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN hit ON hit.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE is_doc
"""
