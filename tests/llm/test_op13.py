"""The filter audit against a plain replay in Python."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from coinfold.llm import op13_filter_audit as op13

LETTERS = "ABCDE"


def plain(rows, labels):
    """(part, order, step) to counts, by going through the documents one by one."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = {}
    shapley = {}
    for d, t, source, *_ in rows:
        text, part = t or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and text in least and d > least[text],
        }
        for order in map("".join, itertools.permutations(LETTERS)):
            alive = True
            for i, c in enumerate(order):
                n = out.setdefault((part, order, i + 1), [0] * 6)
                n[2] += fails[c] and not alive
                n[3] += fails[c] and sum(fails.values()) == 1
                if fails[c] and alive:
                    alive = False
                    n[1] += 1
                    n[4] += d is not None and d in good
                    n[5] += d is not None and d in toxic
                    shapley[part, c] = shapley.get((part, c), 0) + 1
                n[0] += alive
    return {k: (*v, shapley.get((k[0], k[1][k[2] - 1]), 0)) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    def prose(n, many):
        return " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(many)) for _ in range(n))
    texts = [None, "", " \t\n", prose(250, 9000), prose(250, 3), prose(100, 100), "Éa " * 300, prose(240, 9000).upper(), prose(220, 9000) + " 100%", "#" * 5000, prose(30000, 90000)]
    out = [(i, t, ["s0", None, "", "s1"][i % 4]) for i, t in enumerate(texts)]
    out += [(20 + i, texts[3], "hot") for i in range(40)] + [(1, "", "s1"), (3, texts[3], "s0"), (None, texts[3], "s1"), (None, None, None), (None, "new", "s0")]
    return [(*r, "clash", 1, 2, "x") for r in out]


LABELS = [(3, 1, 0), (4, 0, 1), (4, 0, 1), (8, None, 1), (20, 1, 1), (21, 1, None), (None, 1, 1), (77, 1, 1), (5, 0, 0), (5, 1, 0)]
SCHEMA = "doc_id long, text string, source string, part string, fails int, id int, step string"


def test_audit_against_plain_replay(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert found(op13.replay(op13.document_flags(docs, labels))) == plain(rows, LABELS)


def test_audit_of_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert op13.replay(op13.document_flags(docs.limit(0), labels)).collect() == []
    got = found(op13.replay(op13.document_flags(docs, labels.limit(0))))
    assert got == plain(rows, [])


def test_audit_of_other_filters(spark):
    flags = spark.createDataFrame([("p", 1, True, False), ("p", 3, None, None), (None, None, False, True), ("p", 8, True, True)], "part string, fails int, good boolean, toxic boolean")
    got = found(op13.replay(flags, "xy"))
    assert got["p", "xy", 1] == (1, 2, 0, 1, 1, 0, 3)
    assert got["p", "yx", 1] == (2, 1, 0, 0, 0, 0, 1)
    assert got["p", "yx", 2] == (1, 1, 1, 1, 1, 0, 3)
    assert got[None, "xy", 2] == (1, 0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        op13.orders(spark, "xx")
    assert op13.orders(spark, "abc").count() == 6
