"""Lookups in a token registry that outgrows a broadcast."""

from __future__ import annotations

from coinfold import chain_queries as chain
from coinfold.operators import registry as G

SF = "/root/testdata/sf0.001"


def test_registry_is_never_broadcast_whole(spark):
    """The list's file is small and its prefixes are many: no join may gather them in the driver."""
    x = G.asset_labels(chain.named_ledger(spark, SF), chain.registry_from_tpch(spark, SF))
    plan = x._jdf.queryExecution().sparkPlan().toString()
    # What is left to broadcast is the fixed list of aliases.
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftAnti" in line for line in joins) and "SortMergeJoin" in plan


def test_only_prefixes_that_a_text_has_count(spark):
    listed = [("AbcdefghXX", "A", None, 6), ("AbcdefghYY", "B", None, 6), ("Abcz", "C", None, 6)]
    r = G.token_registry(spark.createDataFrame(listed, "mint string, symbol string, name string, decimals int"), with_known=False)
    texts = spark.createDataFrame([("abcdefgh",), ("ABCDEFGHX",), ("abcd",), ("Abcz",), ("abczz",), ("x",), (None,)], "text string")
    got = {q.text: q.token.symbol for q in G.resolved_fragments(texts, r).collect()}
    want = {q.text: q.token.symbol for q in texts.where("text is not null").selectExpr("text", "upper(text) fragment").join(G.by_fragment(r), "fragment").collect()}
    assert got == want == {"abcdefgh": "A", "ABCDEFGHX": "A", "Abcz": "C"}
    assert G.resolved_fragments(texts.where("false"), r).count() == 0
