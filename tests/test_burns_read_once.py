"""What burns are missing comes from one reading of the ledger."""

from __future__ import annotations

from coinfold.operators import classifiers as C
from coinfold.operators.liquidity import inferred_burns, missing_burns
from coinfold.sources.testdata import ledger_from_tpch

SF = "/root/testdata/sf0.001"


def test_the_ledger_is_read_once(spark):
    x = C.liquidity_for_tax(ledger_from_tpch(spark, SF))
    new = missing_burns(x)
    assert new.inputFiles() and all("/coinfold-" in f for f in new.inputFiles())  # stored tables only
    added = inferred_burns(x).where("id like 'lp-dispose-%'").select(*new.columns)
    assert sorted(map(str, new.collect())) == sorted(map(str, added.collect())) and new.count() > 0
