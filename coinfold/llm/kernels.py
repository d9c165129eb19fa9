"""Vectorised text kernels that run inside tasks: words, word hashes, rolling window hashes."""

from __future__ import annotations

from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_SEED = np.random.default_rng(20240229)
BYTE = _SEED.integers(1, 2**63, 256, dtype=U)
R = U(int(_SEED.integers(2**62, 2**63)) | 1)
R_INV = U(pow(int(R), -1, 2**64))
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, letters, every byte of a non-ASCII character.
ALNUM = table_of([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Word bytes of [^\x20\x09-\x0D].
NONSPACE = ~table_of([(0x20, 0x20), (0x09, 0x0D)])


def powers(n: int, base: np.uint64) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 20), base, U)
        p[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes in one array, and where each text begins, the end last. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def words(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every maximal run of word bytes; runs end where a text ends."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = word[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = w[inner]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[inner - 1] = w[inner - 1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.searchsorted(off, ws, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Prefix(NamedTuple):
    """Prefix sums of a polynomial hash, and the bytes."""

    sums: np.ndarray
    buf: np.ndarray


#: Longer spans are hashed byte for byte: modulo 2^64, patterns of some hundred bytes exist that any base maps to one value.
LONG_SPAN = 256


def prefix(buf: np.ndarray) -> Prefix:
    h = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE[buf] * powers(len(buf), R), out=h[1:])
    return Prefix(h, buf)


def span_hash(h: Prefix, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes from s to e, from prefix sums: the same wherever the bytes stand."""
    n = int(e.max(initial=0)) + 1
    out = mix(((h.sums[e] - h.sums[s]) * powers(n, R_INV)[s]) ^ ((e - s).astype(U) * U(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(e - s > LONG_SPAN):
        out[i] = int.from_bytes(blake2b(h.buf[s[i] : e[i]], digest_size=8).digest(), "little")
    return out


def shingles(wh: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their texts; a text of fewer words gives one, of its whole sequence."""
    z = np.zeros(0, U), np.zeros(0, np.int64)
    if not len(wh):
        return z
    mul = [U((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)) for i in range(k)]
    n = len(wh) - k + 1
    if n > 0:
        ok = doc[:n] == doc[k - 1 :]
        s = np.zeros(n, U)
        for i in range(k):
            s = mix(s + wh[i : n + i] * mul[i])
        s, d = s[ok], doc[:n][ok]
    else:
        s, d = z
    count = np.bincount(doc, minlength=n_docs)
    if ((count > 0) & (count < k)).any():
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        few = np.flatnonzero((count > 0) & (count < k))
        t = np.zeros(len(few), U)
        for i in range(k):
            have = count[few] > i
            t[have] = mix(t[have] + wh[np.minimum(begin[few] + i, len(wh) - 1)][have] * mul[i])
        t = mix(t ^ (count[few].astype(U) << U(56)))
        s, d = np.concatenate([s, t]), np.concatenate([d, few])
    return s, d


def distinct_sorted(s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash), ordered by text, then hash."""
    o = np.argsort(s)
    o = o[np.argsort(d[o].astype(np.int16) if len(d) and d.max() < 32000 else d[o], kind="stable")]
    s, d = s[o], d[o]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[keep], d[keep]


def grouped_starts(d: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
