"""Settings of the session that the ledger's plans need."""

from __future__ import annotations

from pyspark.sql import SparkSession

LIMIT = "spark.sql.codegen.hugeMethodLimit"
SPARKS_LIMIT, COMPILED = "65535", "8000"


def compiled_only(spark: SparkSession) -> None:
    """HotSpot compiles no method of over 8,000 bytes. Spark's generated ones for the ledger's long expressions are larger and would run
    interpreted, three times as slow; beyond this limit Spark runs such operators one by one, in small methods. A limit that the caller set stays."""
    if spark.conf.get(LIMIT, SPARKS_LIMIT) == SPARKS_LIMIT:
        spark.conf.set(LIMIT, COMPILED)
