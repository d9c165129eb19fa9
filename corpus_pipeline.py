"""A training corpus from `documents`: toxic texts and near copies go, benchmark passages are cut, sources are mixed, tokens packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coinfold.llm.common import stored, table
from coinfold.llm.op2_decontaminate import decontaminate
from coinfold.llm.op3_minhash import without_near_copies
from coinfold.llm.op5_packing import pack_tokens
from coinfold.llm.op6_toxicity import without_toxic
from coinfold.llm.op7_mixing import mixed_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field doesn't score as toxic; null and empty texts stay, repeated rows go or stay together, an empty table stays empty."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; rows with null or repeated ids are documents of their own, texts without words all stay."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that benchmark items hold; null texts stay null, rows of repeated and null ids are cut each for itself."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to twice; null sources are one source, null and empty texts come as often as complete passes over their source."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids; every row is packed, null and empty texts as an end id, repeated rows each. An empty table gives no rows."""
    return pack_tokens(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("packing", packing)]

#: The stages learn a model, hash and tokenise: SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each reading what the one before it wrote. Columns beyond those of `documents` are carried as far as mixing."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
