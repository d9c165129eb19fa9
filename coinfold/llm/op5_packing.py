"""Token ids packed into rows of fixed length by best-fit decreasing, for training with segment-wise attention.

The vocabulary, a file of fixed size, is broadcast. Texts are tokenised where they lie; tasks fill packs of a bounded number of tokens, so nothing is shuffled and memory
stays bounded. In a pack, documents are split losslessly into chunks of at most the row length, taken in order of decreasing
length, and each goes to the row of least free room that holds it, found in a segment tree over capacities. A row carries its
padded token ids as a binary matrix row, cumulative segment lengths, and the positions at which position ids restart.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256  # free in the vocabulary: ends each document
PACK_TOKENS = 1 << 20
LONG_RUN = 10_000
#: Runs on which the split pattern would step back further than its matcher's stack allows; each run is tried once, from its begin.
_RUNS = re.compile(r"(?<!\s)\s{%d,}+" % LONG_RUN)
_loaded: dict[str, object] = {}


def encoder(vocabulary: bytes | str):
    """The tokenizer of a vocabulary, given as its bytes or as the path of its file."""
    if isinstance(vocabulary, str):
        vocabulary = Path(vocabulary).read_bytes()
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _loaded[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def encode(enc, text: str) -> list[int]:
    """Token ids of a text. White space of `LONG_RUN` characters and more is cut after each such number, so that any text can be split;
    what the ids stand for is the text all the same."""
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in _RUNS.finditer(text):
        for to in range(m.start() + LONG_RUN, m.end() + 1, LONG_RUN):
            ids += enc.encode_ordinary(text[at:to])
            at = to
    return ids + enc.encode_ordinary(text[at:])


class Capacities:
    """A segment tree over capacities 0 to n: how many rows have each free room; finds the least one that is enough."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def least(self, room: int) -> int:
        """The least capacity of at least `room` that some row has, or -1."""
        i = room + self.size
        if self.count[i]:
            return room
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int) -> int:
        i = room + self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is at most `capacity` long."""
    tree = Capacities(capacity)
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            rows.append([])
            row, room = len(rows) - 1, capacity
        else:
            row = tree.take(room)
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def _pack(ids: list[np.ndarray], docs: list, capacity: int, pad: int, key: int) -> pa.RecordBatch | None:
    pieces, owner, offset = [], [], []
    for d, a in enumerate(ids):
        for at in range(0, len(a), capacity):
            pieces.append(a[at : at + capacity])
            owner.append(d)
            offset.append(at)
    cols: dict[str, list] = {k: [] for k in ("token_ids", "cu_seqlens", "resets", "doc_ids", "offsets", "n_tokens", "pack", "numbers")}
    for row in best_fit_decreasing([len(p) for p in pieces], capacity):
        out = np.full(capacity, pad, np.uint16)
        ends = np.cumsum([0] + [len(pieces[i]) for i in row])
        for i, a in zip(row, ends, strict=False):
            out[a : a + len(pieces[i])] = pieces[i]
        cols["token_ids"].append(out.tobytes())
        cols["cu_seqlens"].append(ends)
        cols["resets"].append(ends[:-1])
        cols["doc_ids"].append([docs[owner[i]] for i in row])
        cols["pack"].append(key)
        cols["numbers"].append([owner[i] for i in row])
        cols["offsets"].append([offset[i] for i in row])
        cols["n_tokens"].append(int(ends[-1]))
    kinds = {"token_ids": pa.binary(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.int32(), "pack": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.list_(pa.int32()))) for k, v in cols.items()], list(cols))


def _packer(vocabulary: Broadcast, capacity: int, end: int, pack_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        key = TaskContext.get().partitionId() << 32  # the same when a task runs again
        ids: list[np.ndarray] = []
        docs: list = []
        n = 0
        for x in slices(batches, "text"):
            for d, t in zip(x.column("id").to_pylist(), x.column("text").to_pylist(), strict=True):
                ids.append(np.array([*(encode(enc, t) if t else ()), end], np.uint16))
                docs.append(d)
                n += len(ids[-1])
                if n >= pack_tokens:
                    yield _pack(ids, docs, capacity, end, key)
                    ids, docs, n, key = [], [], 0, key + 1
        if ids:
            yield _pack(ids, docs, capacity, end, key)

    return run


def pack_tokens(
    docs: DataFrame, seq_len: int = 2048, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, pack: int = PACK_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(token_ids, cu_seqlens, resets, doc_ids, offsets, n_tokens, pack, numbers): one row per matrix row of `seq_len` ids.

    token_ids: little-endian 16-bit ids, padded with the end id. Segment i stands at cu_seqlens[i] to cu_seqlens[i+1], belongs to
    doc_ids[i] and begins at token offsets[i] of it; position ids restart at `resets`. Each document ends with one end id; null
    and empty texts are that id alone; a null id stays null. Repeated rows are packed each: (pack, numbers[i]) names the document that segment i
    is of, also where ids are null or repeated. Which documents share a row follows the partitions of the input. An empty table gives no rows; other columns are ignored whatever
    their names.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "token_ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, offsets array<int>, n_tokens int, pack bigint, numbers array<int>"
    with open(os.path.join(tokenizer_dir, vocabulary), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    return src.mapInArrow(_packer(sent, seq_len, END, pack), schema)


def position_ids(cu_seqlens: list[int], seq_len: int) -> np.ndarray:
    """0, 1, 2, ... from each segment's begin; 0 on the padding."""
    out = np.zeros(seq_len, np.int64)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, token_ids): the documents put together again from packed rows, one row for each packed document; ids may repeat or be null."""
    stops = F.slice("cu_seqlens", 2, F.greatest(F.size("cu_seqlens") - 1, F.lit(0))).alias("stops")
    seg = rows.select("token_ids", "pack", F.explode(F.arrays_zip("doc_ids", "numbers", "offsets", "resets", stops)).alias("s"))
    part = seg.select("pack", F.col("s.numbers").alias("number"), F.col("s.doc_ids").alias("doc_id"), F.col("s.offsets").alias("offset"), F.expr("substring(token_ids, 2 * s.resets + 1, 2 * (s.stops - s.resets))").alias("ids"))
    whole = part.groupBy("pack", "number").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("p"))
    ids = F.unhex(F.array_join(F.col("p.h"), ""))
    return whole.select("doc_id", (F.octet_length(ids) / 2).cast("long").alias("n_tokens"), ids.alias("token_ids"))


def write_packed(rows: DataFrame, path: str) -> None:
    """Writes the packed rows as Parquet: the binary column is the id matrix, row by row."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))
