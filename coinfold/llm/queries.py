"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import op1_hnsw, op2_decontaminate, op3_minhash, op4_quality, op5_packing, op6_toxicity, op7_mixing, op8_pii, op9_repeats, op10_chat, op11_lloyd, op12_secrets, op13_filter_audit

QUERIES = {
    "op1_embedding_dedup": op1_hnsw.op1_embedding_dedup,
    "op2_decontamination": op2_decontaminate.op2_decontamination,
    "op3_minhash_dedup": op3_minhash.op3_minhash_dedup,
    "op4_quality": op4_quality.op4_quality,
    "op5_packing": op5_packing.op5_packing,
    "op6_toxicity": op6_toxicity.op6_toxicity,
    "op7_mixing": op7_mixing.op7_mixing,
    "op8_pii": op8_pii.op8_pii,
    "op9_repeats": op9_repeats.op9_repeats,
    "op10_chat": op10_chat.op10_chat,
    "op11_lloyd": op11_lloyd.op11_lloyd,
    "op12_secrets": op12_secrets.op12_secrets,
    "op13_filter_audit": op13_filter_audit.op13_filter_audit,
}
SQL = {
    "op1_embedding_dedup": op1_hnsw.SQL,
    "op2_decontamination": op2_decontaminate.SQL,
    "op3_minhash_dedup": op3_minhash.SQL,
    "op7_mixing": op7_mixing.SQL,
    "op10_chat": op10_chat.SQL,
    "op11_lloyd": op11_lloyd.SQL,
    "op13_filter_audit": op13_filter_audit.SQL,
}
