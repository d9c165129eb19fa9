"""The pipeline against the stages' own rules, on the small tables."""

from __future__ import annotations

import itertools

import numpy as np

import corpus_pipeline
from coinfold.llm import common, op2_decontaminate, op5_packing, op7_mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert docs.count() <= before.count() and docs.select("doc_id").distinct().count() > 0.5 * before.count()
        if name == "near_dedup":
            sets = {r.doc_id: {tuple(r.text.lower().split()[i : i + 5]) for i in range(len(r.text.split()) - 4)} for r in docs.collect()}
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets.values(), 2))
        if name == "decontamination":
            left = op2_decontaminate.contamination(docs, common.table(spark, SF, "benchmark"))
            assert left.where("size(hit_words) > 0").count() == 0
        if name == "mixing":
            plan = {r.doc_id: r.epochs for r in op7_mixing.mix_sources(before).collect()}
            got = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert got == {d: n for d, n in plan.items() if n}
        if name == "packing":
            texts = {r.doc_id: r.text for r in before.collect()}
            enc = op5_packing.encoder(f"{op5_packing.TOKENIZER_DIR}/{op5_packing.VOCABULARY}")
            n = sum(r.n_tokens for r in docs.collect())
            assert n == sum(len(enc.encode_ordinary(r.text or "")) + 1 for r in before.collect()) and set(texts) == set(itertools.chain(*[r.doc_ids for r in docs.collect()]))
            assert all(np.frombuffer(bytes(r.token_ids), np.uint16).size == 2048 for r in docs.collect())
        seen.append(name)
    assert seen == ["toxicity", "near_dedup", "decontamination", "mixing", "packing"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "token_ids" in out.columns
