"""Quality scores by co-training two views of a document.

The content view has hashed words, word endings and word shapes of the text; the metadata view has language, source and declared
length only, so neither sees what the other does. A view's classifier weighs each feature by the log-ratio of its counts in
good and bad documents, times what a logistic regression on the labelled rows makes of it. Counts start from the labelled
rows. In every round each view labels those documents of an unlabelled pool of which it is sure, and their features are counted, in
the tasks, for the other view to learn from. The pool is a share of all documents, so it grows with them; what comes
back are counts, as many as there are features. At the end both views are calibrated on labelled rows that neither was
fitted on, and their calibrated log-odds are combined to score every document.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, labelled_sample, slices, table

BITS = 17
META_BITS = 10
SMOOTH = 1.0
LAYOUT = 0.3
UPPER, LETTER, DIGIT = K.table_of([(0x41, 0x5A)]), K.table_of([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)]), K.table_of([(0x30, 0x39)])


@dataclass
class Sparse:
    """Rows of hashed features: for each entry its column and value, and where each row begins."""

    col: np.ndarray
    val: np.ndarray
    row: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.val, minlength=self.n)

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        ok = place[self.row] >= 0
        return Sparse(self.col[ok], self.val[ok], place[self.row[ok]].astype(np.int32), len(rows))

    @staticmethod
    def stacked(parts: list[Sparse]) -> Sparse:
        base = np.cumsum([0] + [p.n for p in parts])
        return Sparse(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("col", "val")), np.concatenate([p.row + np.int32(b) for p, b in zip(parts, base, strict=False)]), int(base[-1]))


def _normalised(col: np.ndarray, row: np.ndarray, n: int, size: int) -> Sparse:
    pair, count = np.unique(row * size + col, return_counts=True)
    row, col = pair // size, pair % size
    val = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=val * val, minlength=n))
    return Sparse(col.astype(np.int32), (val / np.maximum(norm[row], 1e-9)).astype(np.float32), row.astype(np.int32), n)


def content_view(texts: pa.Array) -> Sparse:
    raw, off = K.flat(texts)
    ws, we, doc = K.words(raw, off, K.NONSPACE)
    if not len(ws):
        return Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), len(texts))
    h = K.prefix(K.LOWER[raw])
    mask = np.uint64((1 << BITS) - 1)
    word = K.span_hash(h, ws, we)
    ending = K.mix(K.span_hash(h, np.maximum(ws, we - 3), we) + np.uint64(1))
    up, let, dig = (np.concatenate([[0], np.cumsum(t[raw])]) for t in (UPPER, LETTER, DIGIT))
    size = we - ws
    u, l, d = up[we] - up[ws], let[we] - let[ws], dig[we] - dig[ws]
    shape = (u == size) * 1 + (u == 1) * 2 + (d > 0) * 4 + (l + d < size) * 8 + (l == 0) * 16 + np.minimum(size // 4, 7) * 32
    shape = K.mix(shape.astype(np.uint64) + np.uint64(7 << 40))
    col = np.concatenate([word & mask, ending & mask, shape & mask]).astype(np.int64)
    x = _normalised(col, np.tile(doc, 3), len(texts), 1 << BITS)
    cols, rows = layout(raw, off, word, doc, len(texts))
    return Sparse(np.concatenate([x.col, cols]), np.concatenate([x.val, np.full(len(cols), LAYOUT, np.float32)]), np.concatenate([x.row, rows]), x.n)


def layout(raw: np.ndarray, off: np.ndarray, word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's layout and their rows: binned shares of kinds of characters, and how many of its words are different."""
    size = np.maximum(np.diff(off), 1)
    total = {k: np.concatenate([[0], np.cumsum(t[raw])]) for k, t in (("upper", UPPER), ("letter", LETTER), ("digit", DIGIT))}
    total |= {chr(c): np.concatenate([[0], np.cumsum(raw == c)]) for c in b"\n.|#"}
    share = {k: (v[off[1:]] - v[off[:-1]]) / size for k, v in total.items()}
    share["other"] = 1 - share["letter"] - share["digit"]
    share["different"] = np.bincount(K.distinct_sorted(word, doc)[1], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
    cols = []
    for k, v in share.items():
        bin_ = np.minimum((v * 20).astype(np.int64), 20) if k in ("letter", "other", "different") else np.minimum(np.log2(1 + v * 1000).astype(np.int64), 11) * 2
        cols.append(np.array([hash_name(f"{k}:{x}", BITS) for x in range(24)], np.int64)[bin_])
    return np.concatenate(cols), np.tile(np.arange(n, dtype=np.int32), len(cols))


def metadata_view(lang: list, source: list, n_chars: list) -> Sparse:
    """Language, source and declared length of a page; nulls are a value of their own."""
    n = len(lang)
    cols = [np.array([hash_name(f"{i}:{x}") for x in named], np.int64) for i, named in enumerate((lang, source, [None if c is None else int(np.log2(max(1, c)) * 2) for c in n_chars]))]
    return Sparse(np.concatenate(cols), np.ones(3 * n), np.tile(np.arange(n), 3), n)


@functools.lru_cache(1 << 16)
def hash_name(name: str, bits: int = META_BITS) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(K.span_hash(K.prefix(raw), np.array([0]), np.array([len(raw)]))[0] & np.uint64((1 << bits) - 1))


def fit_logistic(x: Sparse, y: np.ndarray, size: int, rounds: int = 80, l2: float = 0.05) -> np.ndarray:
    """Weights, the bias last; Adam over all rows, both classes weighing the same."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    pos = max(1.0, y.sum())
    weight = np.where(y > 0, len(y) / 2 / pos, len(y) / 2 / max(1.0, len(y) - y.sum()))
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w[:-1]) + w[-1], -30, 30)))
        g = (p - y) * weight
        d = np.append(np.bincount(x.col, weights=x.val * g[x.row], minlength=size), g.sum())
        d[:-1] += l2 * w[:-1]
        m += 0.1 * (d - m)
        v += 0.01 * (d * d - v)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that make sigmoid(slope z + offset) fit y (Platt, with smoothed targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = max(1e-6, float(np.abs(z).mean()))
    x = np.stack([z / unit, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    prior = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-3)
        step = np.linalg.solve((x * r[:, None]).T @ x + np.diag([0.1, 0.1]), x.T @ (p - t) + 0.1 * (w - prior))
        w = w - step / max(1.0, float(np.abs(step).max()))
        w[0] = max(w[0], 0.05)
    return np.array([w[0] / unit, w[1]])


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, a: Sparse, b: Sparse) -> np.ndarray:
        """Log-odds of both calibrated views, added as independent evidence over the prior."""
        (s1, o1), (s2, o2) = self.calibration
        z1, z2 = s1 * (a.dot(self.content[:-1]) + self.content[-1]) + o1, s2 * (b.dot(self.meta[:-1]) + self.meta[-1]) + o2
        return 1 / (1 + np.exp(-np.clip(z1 + z2 - self.prior, -30, 30)))


class Counts:
    """In how many bad and good documents each feature of a view stands, and how many documents those are."""

    def __init__(self, size: int):
        self.of = np.zeros((2, size + 1), np.int64)

    def add(self, x: Sparse, y: np.ndarray) -> None:
        """y: 0, 1 or -1 for rows that don't count."""
        for k in (0, 1):
            self.of[k] += np.append(np.bincount(x.col[y[x.row] == k], minlength=self.of.shape[1] - 1), (y == k).sum())

    def ratios(self) -> np.ndarray:
        """Log-ratio of a feature's smoothed shares of good and bad documents."""
        bad, good = (self.of[k, :-1] + SMOOTH for k in (0, 1))
        return np.log(good / (self.of[1, -1] + 2 * SMOOTH)) - np.log(bad / (self.of[0, -1] + 2 * SMOOTH))


def fit_view(x: Sparse, y: np.ndarray, counts: Counts) -> np.ndarray:
    """Weights, the bias last: logistic regression on the labelled rows over features scaled by the counts' log-ratios."""
    r = counts.ratios()
    w = fit_logistic(Sparse(x.col, x.val * r[x.col], x.row, x.n), y, len(r))
    return np.append(w[:-1] * r, w[-1])


@dataclass
class Labelled:
    """Both views of the labelled rows to fit on and of those kept for calibration."""

    views: tuple[Sparse, Sparse]
    y: np.ndarray
    fold: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Labelled:
        parts = [_views(x) for x in slices(iter(rows.select(["text", "lang", "source", "n_chars"]).combine_chunks().to_batches()), "text")]
        empty = Sparse(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int32), 0)
        parts = parts or [(empty, empty)]
        ids = rows.column("id").to_pylist()
        fold = np.array([zlib.crc32(f"fold {i}".encode()) % 5 == 0 for i in ids], bool)
        return Labelled(tuple(Sparse.stacked([p[k] for p in parts]) for k in (0, 1)), rows.column("y").to_numpy().astype(np.float64), fold)

    def model(self, counts: tuple[Counts, Counts]) -> Model:
        """The views' classifiers from the rows to fit on and the counts, calibrated on the others."""
        learn = np.flatnonzero(~self.fold)
        hold = np.flatnonzero(self.fold) if len(set(self.y[self.fold])) == 2 else np.arange(len(self.y))
        if len(set(self.y[learn])) < 2:
            p = float(np.clip(self.y.mean() if len(self.y) else 0.5, 0.01, 0.99))
            return Model(np.zeros((1 << BITS) + 1), np.zeros((1 << META_BITS) + 1), (np.array([0, np.log(p / (1 - p))]), np.zeros(2)), 0.0)
        w = [fit_view(x.take(learn), self.y[learn], c) for x, c in zip(self.views, counts, strict=True)]
        z = [x.take(hold).dot(v[:-1]) + v[-1] for x, v in zip(self.views, w, strict=True)]
        rate = np.clip(self.y[hold].mean(), 0.01, 0.99)
        return Model(*(v.astype(np.float32) for v in w), tuple(calibrate(v, self.y[hold]) for v in z), float(np.log(rate / (1 - rate))))

    def counts(self) -> tuple[Counts, Counts]:
        out = Counts(1 << BITS), Counts(1 << META_BITS)
        for c, x in zip(out, self.views, strict=True):
            c.add(x, np.where(self.fold, -1, self.y).astype(np.int64))
        return out


def _views(x: pa.RecordBatch) -> tuple[Sparse, Sparse]:
    return content_view(x.column("text")), metadata_view(*(x.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def pseudo_counts(m: Model, sure: float, views: tuple[Sparse, Sparse], counts: tuple[Counts, Counts]) -> None:
    """Adds rows to the counts of each view under the label of the other one, where that is sure."""
    for i, (w, (slope, offset)) in enumerate(zip((m.content, m.meta), m.calibration, strict=True)):
        p = 1 / (1 + np.exp(-np.clip(slope * (views[i].dot(w[:-1]) + w[-1]) + offset, -30, 30)))
        counts[1 - i].add(views[1 - i], np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1)))


def _pool_counts(m: Model, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(1 << BITS), Counts(1 << META_BITS)
        for x in slices(batches, "text"):
            pseudo_counts(m, sure, _views(x), counts)
        for view, c in enumerate(counts):
            k, f = np.nonzero(c.of)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), view), pa.int32()), pa.array(k, pa.int32()), pa.array(f, pa.int32()), pa.array(c.of[k, f])], ["view", "y", "feature", "n"])

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    cols = [F.col(f"`{c}`").cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *cols)


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, max_bytes: int = 32 << 20, pool_share: float = 1.0, rounds: int = 3, sure: float = 0.9,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Fits on at most `max_labelled` labelled rows and `max_bytes` bytes of text outside the held-out quarter, and on the pool.

    The pool are all texts, or those whose hash is in the first `pool_share` of all; what they are labelled in `labels` is not looked at. A view that is less than
    `sure` of every document adds nothing. Null labels, ids and texts are left out of the labelled rows; of repeated labels the larger one
    counts, of repeated documents the one of least text.
    """
    known = Labelled.of(labelled_sample(_source(docs, id_col, text_col), labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")), "y", max_labelled, max_bytes, "id", "text", "lang", "source", "n_chars"))
    pool = _source(docs, id_col, text_col).where(F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 20)) < round(pool_share * (1 << 20)))
    m = known.model(known.counts())
    for _ in range(rounds):
        counts = known.counts()
        found = pool.mapInArrow(_pool_counts(m, sure), "view int, y int, feature int, n long").groupBy("view", "y", "feature").agg(F.sum("n").alias("n"))
        t = found.toArrow()  # at most two numbers a feature
        view, y, feature, n = (t.column(c).to_numpy() for c in ("view", "y", "feature", "n"))
        for i, c in enumerate(counts):
            c.of[y[view == i], feature[view == i]] += n[view == i]
        m = known.model(counts)
    return m


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of `docs`, 1 for good. Null columns count as values of their own, a null text as empty.

    Null and repeated ids are passed on; an empty table gives no rows; columns other than lang, source and n_chars are ignored.
    """
    src = _source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(model.score(*_views(x)))], ["id", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
