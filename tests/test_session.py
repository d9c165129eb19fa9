"""Ledger queries run without generated methods that the JVM won't compile; a limit of the caller's own stays."""

from __future__ import annotations

import __spark_entry__ as E
from coinfold.functions.session import COMPILED, LIMIT, SPARKS_LIMIT

SF = "/root/testdata/sf0.001"


def test_limit_of_generated_methods(spark):
    one = spark.newSession()
    assert one.conf.get(LIMIT) == SPARKS_LIMIT
    E.queries()["uk_cgt_by_year"](one, SF)
    assert one.conf.get(LIMIT) == COMPILED
    own = spark.newSession()
    own.conf.set(LIMIT, "20000")
    E.queries()["uk_cgt_by_year"](own, SF)
    assert own.conf.get(LIMIT) == "20000"
