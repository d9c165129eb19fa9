"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coinfold.functions import spread

from coinfold.llm import common, kernels, op1_hnsw, op2_decontaminate, op3_minhash, op4_quality, op5_packing, op6_toxicity, op7_mixing, op8_pii, op9_repeats, op10_chat

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, component_id string, runs int, tree string, key string"


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Éps", "zeta9", "eta,", "theta."]) + str(rnd.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [words(rnd, n) for n in (3, 40, 80, 120, 200)]
    texts = [None, "", "  \n", *base, base[2], base[2] + " tail end", "intro " + base[3], base[4].upper(), words(rnd, 30) + " " + base[1] + " " + words(rnd, 10), words(rnd, 20000), "ab" * 400, "x" * 350]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), "clash", 1, "c", 2, "t", "k") for i, t in enumerate(texts)]
    return [*out, out[4], (None, base[2], None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_minhash_against_brute_force(docs, rows):
    got = {r.doc_id: r for r in op3_minhash.minhash_dedup(docs, words=4).collect()}
    sets = {}
    for d, t, *_ in rows:
        if d is None:
            continue
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((comp[a], comp[b]))
            comp = {d: lo if c == hi else c for d, c in comp.items()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items() if d is not None} == {d: (len(s), comp[d]) for d, s in sets.items()}
    assert got[None].component_id is None and got[None].kept


def test_minhash_large_components_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(op3_minhash, "BLOCK", 4)
    monkeypatch.setattr(op3_minhash, "HEADS", 2)
    rnd = random.Random(1)
    base = words(rnd, 60).split()
    texts = []
    for _ in range(40):
        w = base[:]
        for _ in range(rnd.choice([1, 2, 6])):
            w[rnd.randrange(60)] = f"new{rnd.random()}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in op3_minhash.minhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=3).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
    comp = list(range(40))
    for a, b in itertools.combinations(range(40), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    assert [got[i] for i in range(40)] == comp


def test_minhash_recall_just_above_the_threshold(spark):
    rnd = random.Random(9)
    rows, pairs = [], 0
    for i in range(300):
        w = [f"w{rnd.random()}" for _ in range(200)]
        v = w[:]
        v[-20:] = [f"v{rnd.random()}" for _ in range(20)]  # 5-word sets of 196, 176 shared: similarity 0.815
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs += 1
    got = op3_minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").count()
    assert got >= 0.99 * pairs


def test_one_row_of_each_group_of_near_copies_stays(spark, docs, empty, rows):
    rnd = random.Random(2)
    a, b = words(rnd, 60), words(rnd, 60)
    near = a.split()
    near[30] = "other"
    df = spark.createDataFrame([(7, a), (7, a), (7, b), (None, a), (None, " ".join(near)), (2, " ".join(near)), (None, None), (None, ""), (8, None), (9, b)], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in op3_minhash.without_near_copies(df).collect()), key=str)
    assert got == sorted([(2, " ".join(near)), (7, b), (None, None), (None, ""), (8, None)], key=str)
    clash = docs.withColumnsRenamed({"id": "row_of_dedup", "size": "gone_of_dedup", "runs": "row", "tree": "words"})
    out = op3_minhash.without_near_copies(clash)
    assert out.columns == clash.columns and out.count() < len(rows) and op3_minhash.without_near_copies(empty).count() == 0


@pytest.mark.parametrize("groups", [2, 10_000])
def test_components_of_stars(spark, monkeypatch, groups):
    monkeypatch.setattr(spread, "HOT_GROUPS", groups)
    e = [(1000, i) for i in range(300)] + [(2000, 2001 + i) for i in range(50)] + [(299, 301), (5, 4)]
    got = dict(common.connected_components(spark.createDataFrame(e, "src long, dst long")).collect())
    assert {got[i] for i in [*range(300), 301, 1000]} == {0} and {got[i] for i in range(2000, 2051)} == {2000}


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 5), (None, 1), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(common.connected_components(spark.createDataFrame(e, "src long, dst long")).collect())
    assert got[3] == 1 and {got[i] for i in (5, 6, 7, 8, 9)} == {5} and {got[100 + i] for i in range(41)} == {100}


def test_repeats_against_brute_force(docs, rows):
    got = {r.id: r for r in op9_repeats.remove_repeats(docs).collect()}
    texts = {d: (t or "").encode() for d, t, *_ in rows if d is not None}
    seen = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 99):
            seen.setdefault(texts[d][i : i + 100], (d, i))
    for d, b in texts.items():
        m = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] != (d, i):
                m[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, y in zip(b, m) if not y)
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256, bytes(got[d].kept)) == (len(b), sum(m), hashlib.sha256(kept).hexdigest(), kept), d
        assert len(got[d].spans) == len(re.findall(b"\1+", bytes(m)))
    assert got[None].n_removed == 0


@pytest.mark.parametrize("deal", [{"slice_hot": 0, "group_hot": 0, "held": 40}, {"slice_hot": 1, "group_hot": 1, "held": 1 << 19}, {"slice_hot": 10**6, "group_hot": 0}])
def test_hot_paths_of_repeats_against_brute_force(spark, deal):
    rnd = random.Random(8)
    line = words(rnd, 25)
    texts = [words(rnd, 8) + line + words(rnd, 12) + "é" * (i % 3) for i in range(30)] + [line] * 5 + ["z" * 260, words(rnd, 60), ""]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, line), (40, None)]
    got = [(r.id, r.n_removed, r.kept_sha256) for r in op9_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), texts=False, **deal).collect()]
    seen, want = {}, []
    for d, t in enumerate(texts):
        b = t.encode()
        for i in range(len(b) - 99):
            seen.setdefault(b[i : i + 100], (d, i))
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 99):
            if d is not None and seen[b[i : i + 100]] != (d, i):
                m[i : i + 100] = b"\1" * 100
        want.append((d, sum(m), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("deal", [{}, {"slice_hot": 0, "group_hot": 0, "held": 40}, {"slice_hot": 10**6, "group_hot": 0}])
def test_repeats_of_several_texts_of_one_id(spark, deal):
    rnd = random.Random(9)
    a, b = words(rnd, 30), words(rnd, 30)
    rows = [(1, a), (2, a + b), (2, b + "zz"), (3, b), (2, "short"), (2, None), (2, a + b), (3, ""), (4, "x" + b + a), (4, b + "zz"), (None, a), (5, a + "q"), (5, a + "r")]
    got = [(r.id, r.n_removed, r.kept_sha256) for r in op9_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), texts=False, **deal).collect()]
    first, want = {}, []
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - 99 if d is not None else 0):
            first[t[i : i + 100]] = min((d, i), first.get(t[i : i + 100], (d, i)))
    for d, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 99 if d is not None else 0):
            if first[t[i : i + 100]] < (d, i):
                gone[i : i + 100] = b"\1" * 100
        want.append((d, sum(gone), hashlib.sha256(bytes(x for x, y in zip(t, gone) if not y)).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_decontamination_against_brute_force(spark, docs, rows):
    item = rows[6][1].split()
    bench = [(1, " ".join(item[10:40])), (2, "alpha1"), (3, None), (4, ""), (5, " ".join(item[50:54])), (1, " ".join(item[10:40])), (None, "beta2")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.id: r for r in op2_decontaminate.contamination(docs, b).collect()}
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for d, t, *_ in rows:
        w = norm(t)
        hit, found = set(), set()
        for i, x in bench:
            v = norm(x)
            if i is None or not v:
                continue
            k = min(10, len(v))
            wins = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    found.add(str(i))
        assert (got[d].n_words, set(got[d].hit_words), set(got[d].items)) == (len(w), hit, found), d
    blocks = op2_decontaminate.BLOCK_WORDS
    try:
        op2_decontaminate.BLOCK_WORDS = 20
        again = {r.id: r for r in op2_decontaminate.contamination(docs, b).collect()}
    finally:
        op2_decontaminate.BLOCK_WORDS = blocks
    assert {d: (set(r.hit_words), set(r.items)) for d, r in again.items()} == {d: (set(r.hit_words), set(r.items)) for d, r in got.items()}


@pytest.mark.parametrize("spans", [False, True])
def test_blocks_of_the_benchmark_keep_every_row(spark, monkeypatch, spans):
    a, b = words(random.Random(1), 30), words(random.Random(2), 30)
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (1, b), (1, "x " + a), (1, a), (None, a), (None, b), (None, None), (2, "nothing"), (3, a + " and " + b)], "doc_id long, text string").repartition(3)
    scan = lambda: sorted(str(r) for r in op2_decontaminate.contamination(docs, bench, spans=spans).collect())
    want = scan()
    monkeypatch.setattr(op2_decontaminate, "BLOCK_WORDS", 20)
    assert len(want) == 9 and (scan() == want)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_automaton(seed):
    rnd = random.Random(seed)
    items = [[rnd.randrange(3) for _ in range(rnd.randint(1, 9))] for _ in range(5)]
    text = [rnd.randrange(3) for _ in range(60)]
    m = op2_decontaminate.SuffixAutomaton(4).build(items)
    hits, found = m.scan(text, [len(x) for x in items])
    want, who = set(), set()
    for n, x in enumerate(items):
        k = min(4, len(x))
        for p in range(len(text) - k + 1):
            if any(x[j : j + k] == text[p : p + k] for j in range(len(x) - k + 1)):
                want |= set(range(p, p + k))
                who.add(n)
    assert ({i for a, b in hits for i in range(a, b)}, found) == (want, who)


def test_decontaminate_by_blocks_and_with_clashing_names(spark, docs, rows, monkeypatch):
    item = rows[6][1].split()
    b = spark.createDataFrame([(i, " ".join(item[j : j + 15])) for i, j in enumerate((0, 15, 40, 70))], "item_id long, text string")
    clash = docs.withColumnsRenamed({"id": "row_of_scan", "size": "hits_of_scan", "runs": "n_words", "tree": "spans"})
    want = sorted(map(str, op2_decontaminate.decontaminate(clash, b, max_share=0.1).collect()))
    monkeypatch.setattr(op2_decontaminate, "BLOCK_WORDS", 20)
    again = op2_decontaminate.decontaminate(clash, b, max_share=0.1)
    assert sorted(map(str, again.collect())) == want and again.columns == clash.columns and len(want) < len(rows)


def test_decontaminate_cuts_and_drops(spark, docs, rows):
    item = rows[6][1]
    b = spark.createDataFrame([(1, " ".join(item.split()[:40]))], "item_id long, text string")
    out = op2_decontaminate.decontaminate(docs, b)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and got[0].text is None and got[4].text == rows[4][1]
    assert len(got[6].text) < len(item) and got[6].n_chars == len(got[6].text)


def vectors(rnd):
    g = np.random.default_rng(rnd)
    centre = g.normal(size=(12, 16))
    x = np.concatenate([c + g.normal(size=(30, 16)) * s for c, s in zip(centre, itertools.cycle([0.02, 0.1, 0.6]), strict=False)])
    return np.concatenate([x, x[:5], x[:2] * 3])


def test_embeddings_against_brute_force(spark):
    x = vectors(3)
    rows = [(i, [float(a) for a in v], i % 2, "clash") for i, v in enumerate(x)]
    odd = [(900, None, 1, ""), (901, [], 1, ""), (902, [0.0] * 16, 1, ""), (903, [float("nan")] * 16, 1, ""), (904, [None] + [1.0] * 15, 1, ""), (905, rows[0][1], None, ""), (906, [1.0, 2.0], 0, ""), (None, rows[0][1], 0, "")]
    got = {r.vec_id: r for r in op1_hnsw.embedding_dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, component_id string"), shard=64, block=50).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    comp = list(range(len(x)))
    for a, b in zip(*np.nonzero(link), strict=True):
        lo, hi = sorted((comp[a], comp[b]))
        comp = [lo if c == hi else c for c in comp]
    assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == comp
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 907)) and got[None].component_id is None


def test_vectors_that_share_an_id(spark):
    e = [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0], [0.0, 1.001], [-1.0, 0.0], [1.0, 0.0]]
    rows = [(5, e[0], 1), (5, e[1], 1), (9, e[2], 1), (9, e[4], 2), (7, e[3], 1), (3, e[5], 2), (5, e[0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op1_hnsw.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(3, 0, 3, True), (5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 7, True), (9, 0, 9, True), (9, 1, 7, False)]


def test_audit_is_of_fixed_size_and_keeps_its_links(monkeypatch):
    g = np.random.default_rng(2)
    x = op1_hnsw._unit(np.repeat(g.normal(size=(300, 16)), 4, 0) + g.normal(size=(1200, 16)) * 0.02)
    h = op1_hnsw.Hnsw.build(x.astype(np.float32))
    unit, own = x[h.order], np.argsort(h.order)
    truth = {(i, int(own[j])) for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True) if i != j}
    a, b = op1_hnsw.links(h, unit, x, own, 0.98)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert got <= truth and len(got) >= 0.99 * len(truth) and len(got) == len(a)
    monkeypatch.setattr(op1_hnsw.Hnsw, "search", lambda self, q, ef: (np.full((len(q), ef), -2.0), np.full((len(q), ef), -1)))
    a, b = op1_hnsw.links(h, unit, x, own, 0.98)  # a graph that finds nothing fails its audit: exact products
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == truth


def test_graph_recall():
    g = np.random.default_rng(0)
    x = g.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = op1_hnsw.Hnsw.build(x)
    ids = h.search(x[:200], 64)[1][:, :10]
    back = h.order[ids]
    true = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(back, true, strict=True)]) >= 0.9


def test_mixing(docs, rows):
    mix = op7_mixing.mix_sources(docs)
    got = mix.collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, op7_mixing.mix_sources(docs.repartition(2)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = dict(zip(order, itertools.cycle([3, 1, 2]), strict=False))
    budget, free, target = 1.5 * sum(total.values()), set(order), {}
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == total[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine) / 2 + 1


def shared_out(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = dict(zip(order, itertools.cycle(weights), strict=False))
    budget, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 180, "b": 60}, {"a": 300, "b": 100, "c": 200}, {"a": 50, "b": 50, "c": 50}, {"a": 1, "b": 1000, "c": 2}, {"a": 0, "b": 10}, {"a": 0}, {"b": 7, None: 40}, {chr(97 + i): 3 ** (i % 5) for i in range(20)}, {},
])
def test_targets_on_ties_and_caps(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op7_mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = shared_out(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == pytest.approx(want)


def test_a_mix_of_tied_sources_is_not_empty(spark):
    docs = spark.createDataFrame([(1, "w " * 90, "a"), (2, "w " * 90, "a"), (3, "w " * 30, "b"), (4, "w " * 30, "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.target for r in op7_mixing.mix_sources(docs).collect()} == {1: 270, 2: 270, 3: 90, 4: 90}
    assert sum(r.size for r in op7_mixing.mixed_rows(docs).select(op7_mixing.text_size(F.col("text")).alias("size")).collect()) == 360


@pytest.mark.parametrize("quality", [None, 0.27, 0.001, "mixed"])
def test_slices_follow_the_keys(spark, quality, monkeypatch):
    monkeypatch.setattr(op7_mixing, "SLICE", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), (F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.05) if quality == "mixed" else F.lit(quality).cast("double")).alias("q"))
    mix = op7_mixing._mix(docs, (1,), 1.5, 2.0, 1, "doc_id", "text", "source", F.col("q") if quality else None)
    n = [r["count"] for r in mix.groupBy("slice").count().collect()]
    assert max(n) < 60 and sum(n) == 3000 and len(n) > 400


def test_mixed_rows_keep_columns(spark, docs, empty):
    clash = docs.withColumnsRenamed({"id": "row_of_mix", "size": "key_of_mix", "runs": "slice", "tree": "of", "key": "epochs_of_mix"})
    out = op7_mixing.mixed_rows(clash)
    assert out.columns == clash.columns and out.count() == op7_mixing.mixed_rows(docs).count() > 0
    assert op7_mixing.mixed_rows(empty).count() == 0


def test_mixed_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    rows = [(None if i % 3 == 0 else i // 4, words(rnd, rnd.randint(3, 40)), f"s{i % 2}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = op7_mixing.mix_sources(docs).groupBy("doc_id", "source").agg(F.sum("epochs").alias("n"), F.sum("taken").alias("taken")).where("n > 0").collect()
    out = corpus_pipeline.mixing(spark, docs, SF)
    got = out.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.sum(op7_mixing.text_size(F.col("text"))).alias("taken")).collect()
    assert sorted(map(str, got)) == sorted(map(str, plan)) and any(r.doc_id is None for r in got)
    assert out.columns == docs.columns


def test_pii_against_plain_patterns(docs):
    t = "a@b.c_d@e.f x@y 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 +1 (729) 555-7725 5+5 é jo@é.com +12 001.002.003.004 4111-1111-1111-1112 " + "9" * 3000 + " a" * 500 + "@"
    naive = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    got = op8_pii.base_spans(t)
    for kind, p in naive.items():
        want = []
        for m in re.finditer(p, t):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and op8_pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            want.append(m.span())
        assert got[kind] == want, kind
    r = op8_pii.pii_spans(docs).collect()
    assert len(r) == docs.count() and all(x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in r if x.id in (0, 1))


def test_pii_query_against_plain_patterns(spark, tmp_path):
    """The whole query: counts, digest and the spans' base part, in code points, on odd texts."""
    naive = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(6)
    bits = ["a@b.co", "x.y+z@mail.example.org", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (20) 7946-0958", "+1", "é", "𝒳", "١٢٣", "(at)", "dot", "@", ".", " ", "-", "\n", "jo (at) exa [dot] com", "five five five", "0" * 30]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", "  "]) for _ in range(rnd.randint(0, 25))) for _ in range(150)] + [None, "", "é" * 200_000 + " a@b.co", "1" * 200_000, "a" * 200_000 + "@", "+" + "1 " * 100_000]
    spark.createDataFrame([(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_pii.op8_pii(spark, str(tmp_path)).collect()
    want = []
    for i, t in enumerate(texts):
        found = {}
        for kind, p in naive.items():
            found[kind] = []
            for m in re.finditer(p, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn) or kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                found[kind].append(f"{kind}:{m.start()}:{m.end()}")
        base = ",".join(itertools.chain(*found.values()))
        want.append((i if i % 7 else None, *map(len, found.values()), hashlib.sha256(base.encode()).hexdigest(), base))
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=key) == sorted((w[:6] for w in want), key=key)
    bases = {w[5]: set(filter(None, w[6].split(","))) for w in want}
    assert all(bases[r.base_sha256] <= set(r.spans.split(",")) for r in got) and any(r.n_added for r in got)


@pytest.mark.parametrize("text,kind,found", [("to jo (at) exa [dot] com now", "email", "jo (at) exa [dot] com"), ("jo at exa dot com", "email", "jo at exa dot com"), ("é +one two three four five six seven eight", "phone", "+one two three four five six seven eight"), ("１.２.３.４ ok", "ip", "１.２.３.４"), ("jо@exаmple.com", "email", "jо@exаmple.com"), ("meet me at noon", "email", None), ("we won one two games", "phone", None)])
def test_disguises(text, kind, found):
    base = op8_pii.base_spans(text)
    spans = op8_pii.added_spans(text, base).get(kind, [])
    assert [text[a:b] for a, b in spans] == ([found] if found else [])


LONG = " " * 100_000


@pytest.mark.parametrize("text", [
    "jo    (at)    exa     [dot]     com", "jo\n\n\n\n(at) exa [     dot\t\t\t\t] com", "jo     at     exa     dot     com", f"jo{LONG}(at){LONG}exa{LONG}[dot]{LONG}com",
    "jo (at) exa dot com", "jo@exa dot com", "jo at exa [dot] com", "jo @ exa dot com", "jo [at] exa.mail dot com", "jo at exa [.] co dot uk",
    "l" * 90 + " at exa dot com", "jo at " + "h" * 90 + " dot com", "jo at " + "a dot " * 15 + "com", "jo at exa dot " + "m" * 30,
])
def test_disguises_of_any_length_and_mix(text):
    t = f"see {text}, {LONG}"
    spans = op8_pii.added_spans(t, op8_pii.base_spans(t))
    assert {k: [t[a:b] for a, b in v] for k, v in spans.items()} == {"email": [text]}


@pytest.mark.parametrize("text,found", [
    ("look at example.com", []), ("hello @exa dot com", []), ("a@b.co dot com", []), ("at " * 20_000 + "dot", []), ("(at) (dot)", []), ("x at a dot " * 20_000, []),
    ("a@b.co dot joe (at) y (dot) com", ["joe (at) y (dot) com"]), ("look at jo at exa dot com at foo dot net", ["jo at exa dot com"]),
    ("a (at) b dot com, c at d [dot] org and e@f dot net", ["a (at) b dot com", "c at d [dot] org", "e@f dot net"]),
])
def test_disguises_end_where_they_should(text, found):
    spans = op8_pii.added_spans(text, op8_pii.base_spans(text)).get("email", [])
    assert [text[a:b] for a, b in spans] == found


def test_forward_backward_against_enumeration():
    rnd = np.random.default_rng(1)
    e, first, trans = rnd.normal(size=9), np.array([0, 4, 5]), rnd.normal(size=4)
    a, b, _ = op6_toxicity.forward_backward(e, first, trans)
    for s, t in zip(first, [4, 5, 9], strict=True):
        mass = np.zeros(t - s)
        total = 0.0
        for y in itertools.product([0, 1], repeat=t - s):
            z = sum(e[s + i] * v for i, v in enumerate(y)) + y[0] * trans[0] + sum((0, trans[1], trans[3], trans[2])[2 * p + q] for p, q in zip(y, y[1:], strict=False))
            total += np.exp(z)
            mass += np.exp(z) * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(a + b)[s:t])), mass / total)


def test_toxicity_learns_and_marks():
    rnd = random.Random(4)
    texts, y = [], []
    for i in range(300):
        w = words(rnd, 60).split()
        if i % 5 == 0:
            w[rnd.randrange(60)] = w[rnd.randrange(60)] = "vilewort"
        texts.append("É " + " ".join(w))
        y.append(int(i % 5 == 0))
    m = op6_toxicity.fit(pa.array(texts), np.array(y))
    score, spans = op6_toxicity.predict(pa.array([*texts[:40], None, ""]), m)
    assert [int(s >= 0.3) for s in score[:40]] == y[:40] and score[40] == score[41] < 0.3
    assert all(texts[i][s["start"] : s["end"]] == "vilewort" for i in range(40) for s in spans[i])
    none = op6_toxicity.fit(pa.array([], pa.string()), np.zeros(0))
    assert op6_toxicity.predict(pa.array(["a b"]), none)[0][0] < 0.01


@pytest.mark.parametrize("query,least", [(op4_quality.op4_quality, 0.9), (op6_toxicity.op6_toxicity, 0.9)])
def test_held_out_accuracy(spark, query, least):
    sf = "/root/testdata/sf0.01"
    col = "quality" if query is op4_quality.op4_quality else "toxic"
    x = query(spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").select("predicted", col).toPandas()
    assert (x["predicted"] == x[col]).mean() >= least and len(x) > 50


@pytest.mark.parametrize("query,col,positive", [(op4_quality.op4_quality, "quality", 0), (op6_toxicity.op6_toxicity, "toxic", 1)])
def test_held_out_recall_and_precision_of_the_rare_class(spark, query, col, positive):
    x = query(spark, "/root/testdata/sf0.1").where("held_out").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").select("predicted", col).toPandas()
    hit = ((x["predicted"] == positive) & (x[col] == positive)).sum()
    assert hit >= 0.85 * (x[col] == positive).sum() > 0 and hit >= 0.85 * (x["predicted"] == positive).sum()


def test_pool_counts_against_brute_force(spark):
    docs, labels = (common.table(spark, SF, n) for n in ("documents", "labels"))
    m = op4_quality.train(docs, labels, rounds=0)
    pool = op4_quality._source(docs, "doc_id", "text").repartition(5)
    got = {(r.view, r.y, r.feature): r.n for r in pool.mapInArrow(op4_quality._pool_counts(m, 0.9), "view int, y int, feature int, n long").groupBy("view", "y", "feature").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for r in pool.collect():
        views = op4_quality._views(pa.RecordBatch.from_pylist([r.asDict()], pa.schema([("id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
        for i, (w, (slope, offset)) in enumerate(zip((m.content, m.meta), m.calibration, strict=True)):
            x, other = views[i], views[1 - i]
            z = slope * (sum(float(w[c]) * float(v) for c, v in zip(x.col, x.val, strict=True)) + float(w[-1])) + offset
            p = 1 / (1 + np.exp(-z))
            y = 1 if p >= 0.9 else 0 if p <= 0.1 else None
            if y is not None:
                for f in [*other.col.tolist(), (1 << (op4_quality.META_BITS if i == 0 else op4_quality.BITS))]:
                    want[1 - i, y, f] = want.get((1 - i, y, f), 0) + 1
    assert got == want and {k[:2] for k in got} >= {(1, 0), (1, 1)}


def test_views_are_apart(spark):
    batch = pa.RecordBatch.from_pylist([{"id": 1, "text": "one two", "lang": "en", "source": "web", "n_chars": 7}, {"id": 2, "text": "3 # 4 |", "lang": "en", "source": "web", "n_chars": 7}])
    meta = op4_quality._views(batch)[1]
    assert meta.take(np.array([0])).col.tolist() == meta.take(np.array([1])).col.tolist()


def test_sample_to_fit_on_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 4000)) for i in range(60)] + [(1, "a"), (None, "n"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, None)], "doc_id long, toxic int")
    t = common.labelled_sample(docs, labels, "toxic", 50, 16000, "doc_id", "text", "lang").to_pylist()
    assert 0 < len(t) <= 30 and all(len(r["text"]) <= 1000 and r["lang"] is None for r in t) and [r["text"] for r in t if r["id"] == 1] in ([], ["a"])
    some = common.labelled_sample(docs, labels, "toxic", 50, 160_000, "doc_id", "text").to_pylist()
    assert sum(len(r["text"]) for r in some) <= 160_000 and len({r["id"] for r in some}) == len(some) and any(len(r["text"]) == 4000 for r in some)


def test_segment_tree_packing():
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 50) for _ in range(300)]
    rows = op5_packing.best_fit_decreasing(lengths, 50)
    assert sorted(itertools.chain(*rows)) == list(range(300)) and all(sum(lengths[i] for i in r) <= 50 for r in rows)
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(50 - n)
    assert len(rows) == len(room)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" + " \n" * 600_000, "#" * 1_000_000, "x" * 1_000_000, "ab " * 300_000, "\t" * 10_000, " " * 9_999 + "é"], ids=range(7))
def test_packing_of_long_runs(spark, text):
    packed = op5_packing.pack_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    ids = np.frombuffer(bytes(op5_packing.unpack(packed).first().token_ids), np.uint16).tolist()
    assert encoder().decode(ids[:-1]) == text


def encoder():
    with open(f"{op5_packing.TOKENIZER_DIR}/{op5_packing.VOCABULARY}", "rb") as f:
        return op5_packing.encoder(f.read())


def test_cuts_of_long_runs_take_linear_time():
    import time

    runs = ("x" + " " * (op5_packing.LONG_RUN - 1)) * 200
    began = time.time()
    assert op5_packing._RUNS.search(runs) is None and time.time() - began < 2
    spaces = " " * (3 * op5_packing.LONG_RUN + 7)
    enc = encoder()
    ids = op5_packing.encode(enc, "a" + spaces + "b" + spaces)
    assert enc.decode(ids) == "a" + spaces + "b" + spaces
    cuts = [m.span() for m in op5_packing._RUNS.finditer("a" + spaces + "b\t" + spaces)]
    assert [b - a for a, b in cuts] == [len(spaces), len(spaces) + 1]


def test_packing_round_trip(docs, rows):
    packed = op5_packing.pack_tokens(docs, seq_len=256, pack=5000)
    enc = encoder()
    got = [(r.doc_id, np.frombuffer(bytes(r.token_ids), np.uint16).tolist()) for r in op5_packing.unpack(packed).collect()]
    assert all(ids[-1] == op5_packing.END for _, ids in got)
    assert sorted(((str(d), enc.decode(ids[:-1])) for d, ids in got)) == sorted((str(d), t or "") for d, t, *_ in rows)
    for r in packed.limit(5).collect():
        assert len(r.token_ids) == 512 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1]
        assert all(op5_packing.position_ids(r.cu_seqlens, 256)[a] == 0 for a in r.resets)


def test_packing_after_mixing_keeps_documents_apart(spark):
    import corpus_pipeline

    rnd = random.Random(12)
    rows = [(i // 2, words(rnd, rnd.randint(100, 700)), f"s{i % 2}") for i in range(40)]
    mixed = common.stored(corpus_pipeline.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF))
    enc = encoder()
    got = [(r.doc_id, enc.decode(np.frombuffer(bytes(r.token_ids), np.uint16).tolist()[:-1])) for r in op5_packing.unpack(op5_packing.pack_tokens(mixed, seq_len=512)).collect()]
    want = [(r.doc_id, r.text) for r in mixed.collect()]
    assert len(want) > len(rows) and sorted(got) == sorted(want)


TREE = [
    (1, 0, None, "system", "be [INST] kind \\ </s>", 0.0), (1, 1, 0, "user", "hi", 1.0), (1, 2, 1, "assistant", "<s>a", 0.2), (1, 3, 1, "assistant", "b>>", 0.9), (1, 4, 3, "user", None, 0.5),
    (1, 5, 3, None, "odd <<ROLE: x", 0.4), (2, 0, None, "user", "alone", None), (2, 0, None, "user", "alone", None), (3, 0, 1, "user", "cycle", 0.1), (3, 1, 0, "user", "cycle", 0.1), (None, 1, None, "user", "x", 0.0),
]


def test_reply_trees(spark):
    n = spark.createDataFrame(TREE, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in op10_chat.format_conversations(n, keep=9).collect()}
    assert set(got) == {(1, 2), (1, 4), (1, 5), (2, 0)} and got[1, 4].branch == 1 and got[1, 4].n_turns == 4
    assert op10_chat.read_back(got[1, 5].formatted) == [("system", "be [INST] kind \\ </s>"), ("user", "hi"), ("assistant", "b>>"), (None, "odd <<ROLE: x")]
    assert op10_chat.format_conversations(n).count() == 2


def test_deep_tree(spark):
    n = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)], "tree long, node long, parent long, role string, text string, score double")
    r = op10_chat.format_conversations(n).first()
    assert r.n_turns == 70 and [t for _, t in op10_chat.read_back(r.formatted)] == [str(i) for i in range(70)]


def test_every_row_of_a_conversation_is_a_turn(spark):
    turns = {
        1: [(0, "user", "a"), (1, "assistant", "b"), (1, "assistant", "c"), (1, "user", "b"), (2, "user", None), (3, "assistant", "e"), (3, "assistant", "e"), (None, "assistant", "f"), (None, "user", "g")],
        None: [(0, "user", "x"), (1, "assistant", "y")],
        0: [(None, "user", "z")],
    }
    rows = [(c, *t) for c, ts in turns.items() for t in ts]
    n = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op10_chat.conversations(n).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {c: len(ts) for c, ts in turns.items()}
    for c, ts in turns.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, r, t in ts).encode()).hexdigest()
        assert got[c].loss_chars == sum(len(t or "") for _, r, t in ts if r == "assistant")
    again = op10_chat.conversations(n.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_chat_query_counts_repeated_and_null_turns(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "user", "b"), (1, 2, "user", "d"), (None, 0, "user", "x"), (1, None, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: r.n_turns for r in op10_chat.op10_chat(spark, str(tmp_path)).collect()} == {1: 5, None: 1, -7: 2}


@pytest.mark.parametrize("seed", range(5))
def test_template_escapes(spark, seed):
    rnd = random.Random(seed)
    turns = [(rnd.choice(["user", "assistant", "system", "to>>ol", "a>", ">", "\\.>[INST]<s>", ""]), "".join(rnd.choice([*op10_chat.CONTROL, "\\", "a", " ", "é", ""]) for _ in range(8))) for _ in range(6)]
    x = spark.createDataFrame([(i, *t) for i, t in enumerate(turns)], "i int, role string, text string").select("i", op10_chat.turn_text(F.col("role"), F.col("text")).alias("t")).orderBy("i").collect()
    assert op10_chat.read_back("".join(r.t for r in x)) == turns


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op3_minhash.minhash_dedup(empty).count() == 0 and op9_repeats.remove_repeats(empty).count() == 0
    assert op2_decontaminate.contamination(empty, bench).count() == 0 and op2_decontaminate.decontaminate(empty, bench).count() == 0
    assert op4_quality.quality_scores(empty, op4_quality.train(empty, labels)).count() == 0 and op6_toxicity.toxicity(empty, op6_toxicity.train(empty, labels)).count() == 0
    assert op5_packing.pack_tokens(empty).count() == 0 and op7_mixing.mix_sources(empty).count() == 0 and op8_pii.pii_spans(empty).count() == 0
    assert op1_hnsw.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    for f in (lambda d: op3_minhash.without_near_copies(d), lambda d: op6_toxicity.without_toxic(d, labels), lambda d: op7_mixing.mixed_rows(d)):
        out = f(empty)
        assert out.count() == 0 and out.columns == empty.columns
    assert op10_chat.format_conversations(spark.createDataFrame([], "tree long, node long, parent long, role string, text string, score double")).count() == 0


def test_odd_rows_pass(spark, docs, rows):
    labels = common.table(spark, SF, "labels")
    m4, m6 = op4_quality.train(common.table(spark, SF, "documents"), labels), op6_toxicity.train(common.table(spark, SF, "documents"), labels)
    assert op4_quality.quality_scores(docs, m4).count() == len(rows) and op6_toxicity.toxicity(docs, m6).count() == len(rows)
    kept = docs.where(op6_toxicity.toxic_score(m6, F.col("text")) < 0.3)
    assert kept.columns == docs.columns


def test_window_hash_is_the_same_anywhere():
    buf = np.frombuffer(b"abcdefXXabcdef", np.uint8)
    h = kernels.span_hash(kernels.prefix(buf), np.array([0, 8]), np.array([6, 14]))
    assert h[0] == h[1]
