"""What the missing legs' joins deal."""

from __future__ import annotations

import re

from coinfold.operators import app_legs as A
from coinfold.sources.testdata import conform


def test_rows_that_ask_for_nothing_are_not_joined(spark):
    n = spark.range(60).selectExpr("id as n")
    x = conform(n.selectExpr("concat('cdc-', n, '-trade-1') as id", "timestamp_seconds(n) as timestamp", "'A' as asset", "'BUY' as transaction_type", "1.0D as amount", "5.0D as fiat_value_at_trigger", "'cryptocom' as source", "if(n < 5, 'B', null) as counter_asset", "n as seq"))
    out = A.counter_amounts(x)
    assert out.count() == 60
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.match(r"'?Union", plan) and plan.count("Join") == 1
