"""Vector codes against plain rounds in Python integers that sum all parts anew."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from coinfold.llm import op11_lloyd as op11

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts int, error string, delta string, `group` int"


def plain(rows, n_entries, rounds, n_parts=4):
    kept = [(i, [math.floor(1024 * np.float32(x).item()) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // n_parts
    def part(v, p):
        return v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:n_entries]] for p in range(n_parts)]
    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(n_parts)] for _, v, _ in kept]
        for p in range(n_parts):
            for i in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for i, v, label in kept:
        best = [near(v, p) for p in range(n_parts)]
        out.append((i, None if label is None else str(label), "".join(f"{c:02x}" for _, c in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", *r[2:])


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(i, [rnd.uniform(-1, 1) for _ in range(8)], rnd.choice([None, 0, 1])) for i in range(60)]
    same = [0.25, -0.5] * 4
    out += [(100 + i, same, 2) for i in range(40)]  # a third of all rows, ties between equal entries
    out += [(3, same, 1), (3, same, 1), (None, same, 1), (None, [0.5] * 8, None)]
    out += [(200, None, 0), (201, [], 0), (202, [0.1] * 7 + [None], 0), (203, [0.1] * 7 + [float("nan")], 0), (204, [float("-inf")] * 8, 0), (205, [0.1] * 12, 0), (206, [0.1] * 7, 0)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("entries,rounds", [(16, 4), (256, 4), (2, 7), (5, 0)])
def test_codes_against_plain_rounds(spark, rows, entries, rounds):
    got, books = op11.compress(frame(spark, rows).repartition(3), n_entries=entries, rounds=rounds)
    want, digest = plain(rows, entries, rounds)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert books.digest() == digest


def test_only_changed_parts_are_moved(spark, rows, monkeypatch):
    seen = []
    real = op11._contributions
    monkeypatch.setattr(op11, "_contributions", lambda step, shape: seen.append((step.where("delta is not null").count(), real(step, shape))) or seen[-1][1])
    op11.compress(frame(spark, rows), n_entries=4, rounds=40)
    assert len(seen) < 40  # rounds end when no part changed
    assert seen[-1][0] == 0 and seen[0][0] > 0
    assert all((c.sum(1) == 0).all() for _, (_, c) in seen[1:])  # what one entry gains another loses


def test_no_rows_and_large_components(spark, rows):
    got, books = op11.compress(frame(spark, rows).limit(0))
    assert got.collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    huge = [(1, [3e38, 0.0, 1.0, -3e38], 1), (2, [9e3] * 4, 1), (3, [-9e3] * 4, 1), (4, [8999.0] * 4, 1)]
    got, _ = op11.compress(frame(spark, huge), n_entries=2, rounds=3)
    assert {r.vec_id: r.error >= 0 for r in got.collect()} == dict.fromkeys((1, 2, 3, 4), True)
    with pytest.raises(ValueError):
        op11.compress(frame(spark, rows), n_entries=0)


def test_exact_integers_beyond_doubles():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 0]])
    e = np.array([[-(1 << 26), 1 << 26], [0, 0], [0, 0]])
    code, error = op11.nearest(x, e)
    assert code.tolist() == [1, 1] and error.tolist() == [2 << 52, ((1 << 26) - 1) ** 2]


def test_query_sums_errors_by_label(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11.op11_lloyd(spark, str(tmp_path)).collect()
    want, digest = plain(rows, 256, 4)
    total = {}
    for _, label, _, e in want:
        total[label] = total.get(label, 0) + e
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(((i, c, e, total[x]) for i, x, c, e in want), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert {r.codebooks_sha256 for r in got} == {digest}
