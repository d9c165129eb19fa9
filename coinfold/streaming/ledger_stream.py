"""Streams of ledger rows: duplicates dropped within the watermark, calendar windows, and the pool kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_ledger(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """One row for each id among rows at most `delay` apart."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def daily_totals(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Rows and value by day and kind, final once the watermark has passed the day."""
    w = F.window("timestamp", "1 day")
    return stream.withWatermark("timestamp", delay).groupBy(w.alias("w"), "transaction_type").agg(F.count("*").alias("n"), F.sum("fiat_value_at_trigger").alias("value")).select(F.to_date("w.start").alias("day"), "transaction_type", "n", "value")


def _pool(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    quantity, cost = (Decimal(x) for x in state.get) if state.exists else (Decimal(0), Decimal(0))
    rows = pd.concat(list(frames), ignore_index=True)
    out = []
    for r in rows.assign(o=rows["kind"] != "A").sort_values(["timestamp", "o", "id"]).itertuples(index=False):
        q, v = Decimal(str(r.quantity)), Decimal(str(r.value))
        if r.kind == "A":
            quantity, cost = quantity + q, cost + v
            continue
        take = min(q, quantity)
        part = cost * take / quantity if take > 0 else Decimal(0)
        quantity, cost = quantity - take, cost - part
        out.append((key[0], r.id, r.timestamp, float(take), round(float(v * take / q), 2), round(float(part), 2), float(quantity), round(float(cost), 2)))
    state.update((str(quantity), str(cost)))
    yield pd.DataFrame(out, columns=["asset", "id", "timestamp", "quantity", "proceeds", "cost", "pool_quantity", "pool_cost"])


def pooled(stream: DataFrame) -> DataFrame:
    """Disposals at average cost from a pool for each asset, in order inside a batch and between batches.

    stream: id, asset, timestamp, kind (A or D), quantity, value. Rows that come after later ones were worked on are taken at the pool as it
    then is: such results are provisional, the batch engine is the final word.
    """
    schema = "asset string, id string, timestamp timestamp, quantity double, proceeds double, cost double, pool_quantity double, pool_cost double"
    return stream.groupBy("asset").applyInPandasWithState(_pool, schema, "quantity string, cost string", "append", GroupStateTimeout.NoTimeout)
