"""Training-data operators: near-dedup, decontamination, classifiers, packing, mixing, PII and chat formatting.

Nothing outside this subpackage imports it.
"""
