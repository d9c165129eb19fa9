"""Toxic spans by a linear-chain conditional random field.

Tokens are words, sequences are sentences. Labels are given by document, so labelled tokens come first: in a bounded sample of
labelled training documents without near copies, words and word beginnings that occur significantly more often in toxic
documents mark the tokens of toxic documents; tokens of clean documents are clean. The field has hashed features of the word
and its beginnings and transition weights between the two tags; forward-backward recursions give exact gradients and
marginals, in log-odds form for a whole batch of sentences at a time. A document's score is a logistic function of its largest
and summed marginals, fitted on the training documents; the offending offsets are the tokens above one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, labelled_sample, slices, table

BITS = 18
BEGINNINGS = (4, 5, 6, 7, 8)
BREAKS = K.table_of([(0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)])


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray  # start, O to T, T to T, T to O
    score: np.ndarray  # bias, largest marginal, log of 1 + sum


@dataclass
class Tokens:
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    off: np.ndarray
    buf: np.ndarray
    features: np.ndarray  # tokens x features, hashed
    first: np.ndarray  # where sentences begin


def tokens(texts: pa.Array) -> Tokens:
    raw, off = K.flat(texts)
    buf = K.LOWER[raw]
    ws, we, doc = K.words(buf, off, K.ALNUM)
    feats = np.zeros((len(ws), 1 + len(BEGINNINGS)), np.int32)
    first = np.zeros(0, np.int64)
    if len(ws):
        h = K.prefix(buf)
        mask = np.uint64((1 << BITS) - 1)
        feats[:, 0] = (K.span_hash(h, ws, we) & mask).astype(np.int32)
        for i, n in enumerate(BEGINNINGS):
            cut = np.minimum(ws + n, we)
            feats[:, i + 1] = np.where(we - ws >= n, (K.mix(K.span_hash(h, ws, cut) ^ np.uint64(0xA5A5A5A5)) & mask).astype(np.int32), -1)
        breaks = np.concatenate([[0], np.cumsum(BREAKS[buf])])[ws]
        first = np.flatnonzero(np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])]))
    return Tokens(ws, we, doc, off, raw, feats, first)


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    e = np.zeros(len(features))
    for i in range(features.shape[1]):
        f = features[:, i]
        e += np.where(f >= 0, weights[np.maximum(f, 0)], 0.0)
    return e


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log-odds of the toxic tag at each token, and the order of sentences used."""
    start, ot, tt, to = trans
    length = np.diff(np.append(first, len(e)))
    order = np.argsort(-length, kind="stable")
    begin, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    alpha, beta = np.empty(len(e)), np.zeros(len(e))
    for t, n in enumerate(active):
        at = begin[:n] + t
        if t:
            a = alpha[at - 1]
            alpha[at] = e[at] + np.logaddexp(tt + a, ot) - np.logaddexp(to + a, 0)
        else:
            alpha[at] = e[at] + start
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        b = e[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(tt + b, to) - np.logaddexp(ot + b, 0)
    return alpha, beta, order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marginals(t: Tokens, m: Model) -> np.ndarray:
    e = emissions(t.features, m.weights)
    a, b, _ = forward_backward(e, t.first, m.trans)
    return _sigmoid(a + b)


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((n, 3))
    x[:, 0] = 1
    if len(p):
        np.maximum.at(x[:, 1], doc, p)
        x[:, 2] = np.log1p(np.bincount(doc, weights=np.where(p > 0.05, p, 0), minlength=n))
    return x


def _minhashes(t: Tokens, n: int) -> np.ndarray:
    """Two minhashes of each text's 5-word shingles; texts without words get a value of their own."""
    h = K.span_hash(K.prefix(K.LOWER[t.buf]), t.begin, t.end)
    s, d = K.distinct_sorted(*K.shingles(h, t.doc, n, 5))
    out = K.mix(np.arange(2 * n, dtype=np.uint64).reshape(n, 2) + np.uint64(1 << 62))
    at = K.grouped_starts(d)
    for i in range(2):
        if len(at):
            out[d[at], i] = np.minimum.reduceat(K.mix(s ^ np.uint64(i + 1)), at)
    return out


class Counts:
    """In how many documents, and in how many toxic ones, each feature stands."""

    def __init__(self) -> None:
        self.all = np.zeros((1 + len(BEGINNINGS), 1 << BITS), np.int32)
        self.bad = np.zeros_like(self.all)

    def add(self, t: Tokens, toxic: np.ndarray, keep: np.ndarray) -> None:
        for i in range(t.features.shape[1]):
            f = t.features[:, i].astype(np.int64)
            use = (f >= 0) & keep[t.doc]
            pair = np.unique(f[use] * len(toxic) + t.doc[use])
            self.all[i] += np.bincount(pair // len(toxic), minlength=1 << BITS)
            self.bad[i] += np.bincount(pair[toxic[pair % len(toxic)] > 0] // len(toxic), minlength=1 << BITS)

    def strong(self, rate: float) -> np.ndarray:
        """Features whose share of toxic documents is high, and significantly so."""
        if not 0 < rate < 1:
            return np.zeros(self.all.shape, bool)
        q = np.clip(self.bad / np.maximum(self.all, 1), 1e-9, 1 - 1e-9)
        surprise = self.all * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate)))
        return (q >= 0.8) & (surprise >= 9.5)


def _fit_field(features: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the exact gradient of the conditional likelihood."""
    w, trans = np.zeros(1 << BITS), np.array([-1.0, -1.0, 0.0, 0.0])
    flat = [(f >= 0, np.maximum(f, 0)) for f in features.T]
    inner = np.ones(len(y), bool)
    inner[first] = False
    here = np.flatnonzero(inner)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros(4), np.zeros(4)]
    for step in range(1, rounds + 1):
        e = emissions(features, w)
        a, b, _ = forward_backward(e, first, trans)
        p = _sigmoid(a + b)
        g = p - y
        gw = np.zeros_like(w)
        for ok, f in flat:
            gw += np.bincount(f[ok], weights=g[ok], minlength=len(w))
        gw += l2 * w
        # Pairwise marginals: scores of OO, OT, TT, TO around each inner token, normalised.
        prev, nxt = a[here - 1], e[here] + b[here]
        s = np.stack([np.zeros(len(here)), trans[1] + nxt, trans[2] + prev + nxt, trans[3] + prev])
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        yp, yn = y[here - 1], y[here]
        gt = np.array([g[first].sum(), (s[1] - (1 - yp) * yn).sum(), (s[2] - yp * yn).sum(), (s[3] - yp * (1 - yn)).sum()]) + l2 * trans
        for x, d, m, v in ((w, gw, state[0], state[1]), (trans, gt, state[2], state[3])):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, trans


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> np.ndarray:
    """Newton steps of bounded length, so that classes which features tell apart fully don't make it overshoot."""
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    reg = np.full(len(w), l2)
    reg[0] = 1e-2
    for _ in range(200):
        p = _sigmoid(x @ w)
        r = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * r[:, None]).T @ x + np.diag(reg), x.T @ (p - y) + reg * w)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 40, l2: float = 0.02, seed: int = 5) -> Model:
    """Works through the texts in slices of bounded size, several times; only the sentences to learn from are held."""
    toxic = toxic.astype(np.float64)
    n = len(toxic)
    whole = pa.RecordBatch.from_arrays([texts], ["text"])

    def parts() -> Iterator[tuple[slice, Tokens]]:
        at = 0
        for x in slices(iter([whole]), "text"):
            yield slice(at, at + x.num_rows), tokens(x.column("text"))
            at += x.num_rows

    hashes = np.concatenate([_minhashes(t, p.stop - p.start) for p, t in parts()]) if n else np.zeros((0, 2), np.uint64)
    keep = np.ones(n, bool)
    for i in range(2):
        first = np.zeros(n, bool)
        first[np.unique(hashes[:, i], return_index=True)[1]] = True
        keep &= first
    counts = Counts()
    for p, t in parts():
        counts.add(t, toxic[p], keep[p])
    strong = counts.strong(float(toxic[keep].mean()) if keep.any() else 0.0)
    rng = np.random.default_rng(seed)
    features, tags, heads = [np.zeros((0, 1 + len(BEGINNINGS)), np.int32)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for p, t in parts():
        if not len(t.doc):
            continue
        mark = np.zeros(len(t.doc), bool)
        for i in range(t.features.shape[1]):
            f = t.features[:, i]
            mark |= (f >= 0) & strong[i][np.maximum(f, 0)]
        mark &= toxic[p][t.doc] > 0
        sentence = np.repeat(np.arange(len(t.first)), np.diff(np.append(t.first, len(t.doc))))
        marked = np.bincount(sentence, weights=mark) > 0
        # All marked sentences, and a share of the others about four times as large.
        use = (marked | (rng.random(len(t.first)) < min(1.0, (4 * marked.sum() + 50) / len(t.first)))) & keep[p][t.doc[t.first]]
        at = use[sentence]
        heads.append(K.grouped_starts(sentence[at]) + sum(map(len, tags)))
        features.append(t.features[at])
        tags.append(mark[at].astype(np.float64))
    w, trans = _fit_field(np.concatenate(features), np.concatenate(tags), np.concatenate(heads), rounds, l2)
    m = Model(w.astype(np.float32), trans, np.zeros(3))
    x = np.concatenate([document_features(marginals(t, m), t.doc, p.stop - p.start) for p, t in parts()]) if n else np.zeros((0, 3))
    m.score = _fit_logistic(x[keep], toxic[keep]) if keep.any() else np.array([-9.0, 0, 0])
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most `max_rows` labelled rows and `max_bytes` bytes of text outside the held-out quarter, those of least hash of the id.

    Null labels and texts are left out; of repeated labels the larger one counts, of repeated documents the one of least text. Without
    any row the score is near 0 everywhere.
    """
    t = labelled_sample(docs, labels, label_col, max_rows, max_bytes, id_col, text_col)
    return fit(t.column("text").combine_chunks(), t.column("y").to_numpy())


def predict(texts: pa.Array, m: Model) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
    """Scores, and spans (code points, end exclusive) of neighbouring tokens whose marginal is at least one half."""
    t = tokens(texts)
    n = len(texts)
    p = marginals(t, m)
    score = _sigmoid(document_features(p, t.doc, n) @ m.score)
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    hot = np.flatnonzero(p >= 0.5)
    if len(hot):
        chars = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
        runs = np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (np.diff(t.doc[hot]) > 0)) + 1)
        for r in runs:
            d = int(t.doc[r[0]])
            base = chars[t.off[d]]
            spans[d].append({"start": int(chars[t.begin[r[0]]] - base), "end": int(chars[t.end[r[-1]]] - base)})
    return score, spans


def _scores(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "text"):
            score, spans = predict(x.column("text"), m)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(score), pa.array(spans, kind)], ["id", "score", "spans"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans): one row per row of `docs`. Null and empty texts get the score of a text without tokens and no spans.

    Null and repeated ids are passed on; an empty table gives no rows; other columns are ignored whatever their names.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(_scores(model), f"id {src.schema['id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int>>")


def toxic_score(model: Model, text: Column) -> Column:
    """The score as a column, for filters that pass all other columns on."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        at = 0
        for x in slices(iter([batch]), "text"):
            out[at : at + x.num_rows] = predict(x.column("text"), model)[0]
            at += x.num_rows
        return pa.array(out)

    return score(text.cast("string"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kw) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold; rows and columns are otherwise as they were.

    Each row is judged by its own text: null and empty texts stay, null ids too, and repeated rows stay or go together. An empty table gives an
    empty one.
    """
    return docs.where(toxic_score(train(docs, labels, **kw), F.col(kw.get("text_col", "text"))) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
