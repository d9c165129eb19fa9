"""Transfers of a stream paired across venues: a one-to-one choice among the legs in state, and their candidates by an interval join.

The choice keeps a leg only as long as a leg of the other side may still come within the window. It
waits for a leg out until the watermark says that all its candidates are there; then legs out, in order of time, take the
unused leg in of least score, as `operators.pairing.transfer_pairs` does over a whole ledger.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pairing import Nearest, chosen
from .packed import PACKED, packed, unpacked
from .uk_stream import STATE_STORE

PAIRS = "asset string, out_id string, in_id string, pair_id string"


def streamed_candidates(legs: DataFrame, window_hours: float = 48, delay: str = "1 day") -> DataFrame:
    """(asset, out_ts, out_id, in_id, in_at, score) of a stream of ledger rows, by an interval join that both watermarks bound.

    The join's key is the asset and a bucket of time of the window's length, in which a leg in stands with its neighbours too: a leg meets the legs
    of three windows in the state, not all that its asset has.
    """
    t = legs.where("transaction_type = 'TRANSFER' and transfer_pair_id is null and amount > 0 and id is not null")
    side = lambda way, k: t.where(F.col("transfer_direction") == way).select(
        F.col("asset").alias(f"{k}_asset"), F.col("id").alias(f"{k}_id"), F.col("source").alias(f"{k}_source"), F.col("timestamp").alias(f"{k}_ts"), F.col("amount").alias(f"{k}_amount")
    ).withWatermark(f"{k}_ts", delay).withColumn(f"{k}_bucket", F.floor(F.unix_micros(f"{k}_ts") / 1e6 / (window_hours * 3600)))
    b = F.col("in_bucket")
    into = side("IN", "in").withColumn("in_bucket", F.explode(F.array(b - 1, b, b + 1)))
    fee, at = F.col("out_amount") - F.col("in_amount"), lambda k: F.unix_micros(f"{k}_ts") / 1e6
    near = F.expr(f"in_ts >= out_ts - interval {int(window_hours * 3600)} seconds and in_ts <= out_ts + interval {int(window_hours * 3600)} seconds")
    fits = (F.col("in_amount") <= F.col("out_amount") * 1.0005) & (fee <= F.greatest(F.col("out_amount") * 0.01, F.lit(1e-8))) & (fee <= F.col("out_amount") * 0.02)
    other = F.coalesce(F.col("out_source") != F.col("in_source"), F.lit(True))
    x = side("OUT", "out").join(into, (F.col("out_asset") == F.col("in_asset")) & (F.col("out_bucket") == F.col("in_bucket")) & near & fits & other)
    score = F.abs(fee) * 1e6 + F.abs(at("in") - at("out"))
    return x.select(F.col("out_asset").alias("asset"), "out_ts", "out_id", "in_id", at("in").alias("in_at"), at("out").alias("out_at"), score.alias("score"))


LEGS = pa.schema([("out", pa.bool_()), ("at", pa.float64()), ("id", pa.string()), ("amount", pa.float64()), ("mark", pa.string())])


class Choice(StatefulProcessor):
    """An asset's legs out that may still get more to choose from, the legs in that may still be asked for, and which of those are taken."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.legs = handle.getListState("legs", PACKED)
        self.used = handle.getListState("used", "id string, at double")

    def _wake(self, at: float | None) -> None:
        """A leg out is ready when the watermark is a window beyond it, a leg in of no more use after two."""
        if at is not None:
            self.handle.registerTimer(int((at + self.seconds) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = [pdf[LEGS.names] for pdf in rows]
        self.legs.appendList([packed(x, LEGS) for x in pieces])
        self._wake(min(x["at"].min() for x in pieces))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        legs = unpacked(self.legs.get(), LEGS).sort_values(["at", "id", "out"], kind="stable")
        taken = {r[0]: r[1] for r in self.used.get()}
        waits: deque = deque()
        into, when = Nearest(self.seconds, self.seconds, other=True), {}
        into.used = set(taken)
        found: list[tuple[str, str]] = []
        for out, *leg in zip(*[legs[c].tolist() for c in LEGS.names], strict=True):
            found += chosen(waits, into, min(leg[0], now))  # legs out beyond the watermark wait for what may still come
            if out:
                waits.append(tuple(leg))
            else:
                into.put(*leg)
                when[leg[1]] = leg[0]
        found += chosen(waits, into, now)
        taken |= {i: when[i] for _, i in found}
        # A leg in that lies two windows back is asked for by no leg out to come, nor by one that waits.
        kept = [(i, at) for i, at in taken.items() if at >= now - 2 * self.seconds]
        waiting = now - legs["at"] <= self.seconds
        rest = legs[(legs["out"] & waiting) | (~legs["out"] & (legs["at"] >= now - 2 * self.seconds) & ~legs["id"].isin(list(taken)))]
        self.legs.put([packed(rest, LEGS)]) if len(rest) else self.legs.clear()
        self.used.put(kept) if kept else self.used.clear()
        if len(rest):
            first_out, first_in = rest.loc[rest["out"], "at"].min(), rest.loc[~rest["out"], "at"].min() + self.seconds
            self._wake(min(x for x in (first_out, first_in) if x == x))
        yield pd.DataFrame([(key[0], o, i, f"pair-{o}") for o, i in found], columns=["asset", "out_id", "in_id", "pair_id"])


def streamed_pairs(legs: DataFrame, window_hours: float = 48, delay: str = "1 day") -> DataFrame:
    """(asset, out_id, in_id, pair_id): each pair once, as soon as no earlier candidate can come. Rows over `delay` older than the newest are
    left out, as late; null assets have no pair. Needs `STATE_STORE` as the session's state store.

    The state holds legs, not candidates, whose number grows with the square of the legs."""
    t = legs.where("transaction_type = 'TRANSFER' and transfer_pair_id is null and amount > 0 and not isnan(amount) and id is not null and asset is not null and transfer_direction in ('OUT', 'IN')").withWatermark("timestamp", delay)
    x = t.select("asset", "timestamp", (F.col("transfer_direction") == "OUT").alias("out"), (F.unix_micros("timestamp") / 1e6).alias("at"), "id", F.col("amount").cast("double").alias("amount"), F.col("source").alias("mark"))
    return x.groupBy("asset").transformWithStateInPandas(statefulProcessor=Choice(window_hours * 3600), outputStructType=PAIRS, outputMode="Append", timeMode="EventTime")


def replayed(ledger: DataFrame, folder: str, window_hours: float = 48, delay: str = "1 day") -> DataFrame:
    """The stream's pairs of a whole ledger, written to `folder` and read from there, with a leg of each side far beyond the others, so that the
    watermark passes all of them."""
    spark = ledger.sparkSession
    one = spark.newSession()
    one.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    columns = ["id", "asset", "source", "timestamp", "amount", "transaction_type", "transfer_direction", "transfer_pair_id"]
    legs = ledger.where("transaction_type = 'TRANSFER'").select(*columns)  # other rows pair with nothing and need not be written
    legs.write.parquet(f"{folder}/legs")
    end = legs.agg(F.max("timestamp").alias("t")).where("t is not null").select((F.col("t") + F.expr("interval 400 days")).alias("timestamp"), F.explode(F.array(F.lit("OUT"), F.lit("IN"))).alias("transfer_direction"))
    end = end.select(F.concat(F.lit("end-"), "transfer_direction").alias("id"), F.concat(F.lit("end-"), "transfer_direction").alias("asset"), F.lit("").alias("source"), "timestamp", F.lit(1.0).alias("amount"), F.lit("TRANSFER").alias("transaction_type"), "transfer_direction", F.lit(None).cast("string").alias("transfer_pair_id"))
    end.write.mode("append").parquet(f"{folder}/legs")
    stream = one.readStream.schema(legs.schema).parquet(f"{folder}/legs")
    q = streamed_pairs(stream, window_hours, delay).writeStream.format("parquet").option("path", f"{folder}/pairs").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(PAIRS).parquet(f"{folder}/pairs")
