"""UK share matching: same day, the following 30 days, then the Section 104 pool."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal, getcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ledger_ops import with_rate

ROWS = (
    "asset string, row_kind string, match_type string, day date, disposal_id string, quantity decimal(38,12), proceeds decimal(38,12), cost decimal(38,12), acquisition_id string, pool_quantity decimal(38,12), pool_cost decimal(38,12), first_day date"
)


def uk_legs(ledger: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Spot acquisitions and disposals with their UK day and GBP value; fees add to cost and take from proceeds.

    A transfer in without a pair and value is no acquisition; with a value it is one. Fee rows are disposals at their value.
    """
    t, dirn = F.col("transaction_type"), F.col("transfer_direction")
    loose = (t == "TRANSFER") & F.col("transfer_pair_id").isNull()
    value, fee = F.coalesce("fiat_value_at_trigger", F.lit(0.0)), F.coalesce("fee_fiat", F.lit(0.0))
    kind = F.when(t.isin(*S.ACQUISITIONS) | (loose & (dirn == "IN") & (value > 0)), "A").when(t.isin(*S.DISPOSALS) | (loose & (dirn == "OUT")), "D")
    exact = lambda c: c.cast("decimal(24,6)")
    net = F.when(kind == "A", exact(value) + exact(fee)).when(t == "FEE", exact(value)).otherwise(exact(value) - exact(fee))
    x = with_rate(ledger, "GBP", rates).where(~S.is_perp(F.col("instrument_kind"), F.col("source")) & ~S.is_stable(F.col("asset")) & (F.col("amount") > 0))
    return x.select("id", "asset", "timestamp", S.uk_day(F.col("timestamp")).alias("day"), kind.alias("kind"), F.col("amount").cast("decimal(38,8)").alias("quantity"), (net.cast("decimal(24,6)") * F.col("fx_rate")).cast("decimal(38,12)").alias("value")).where("kind is not null")


def same_day_events(legs: DataFrame) -> DataFrame:
    """All acquisitions of an asset on one UK day are one, and so are all disposals; ids joined in order of time and id."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id"))), lambda x: x["id"]), "+")
    return legs.groupBy("asset", "day", "kind").agg(F.sum("quantity").alias("quantity"), F.sum("value").cast("decimal(38,12)").alias("value"), F.min("timestamp").alias("first_at"), F.count("*").alias("n_legs"), ids.alias("ids"))


def same_day_matches(events: DataFrame) -> DataFrame:
    a = events.where("kind = 'A'").select("asset", "day", F.col("quantity").alias("acquired"), F.col("ids").alias("acquisition_id"))
    d = events.where("kind = 'D'").select("asset", "day", F.col("quantity").alias("disposed"), F.col("ids").alias("disposal_id"))
    return a.join(d, ["asset", "day"]).select("asset", "day", "disposal_id", "acquisition_id", F.least("acquired", "disposed").alias("quantity"))


def _fold(asset: str | None, events: list[tuple]) -> list[tuple]:
    """One pass over an asset's days (day, kind, quantity, value, ids). Disposals wait 30 days for later acquisitions; what is left goes to
    the pool in day order."""
    days: dict = {}
    for day, kind, quantity, value, ids in events:
        q = Decimal(quantity)
        days.setdefault(day, {})[kind] = {"q": q, "left": q, "value": Decimal(value), "id": ids, "day": day}
    rows: list[tuple] = []
    eps = Decimal("1e-9")

    def match(kind: str, d: dict, a: dict) -> None:
        q = min(d["left"], a["left"])
        d["left"] -= q
        a["left"] -= q
        rows.append((asset, "match", kind, d["day"], d["id"], q, d["value"] * q / d["q"], a["value"] * q / a["q"], a["id"], None, None, None))

    waiting: deque = deque()
    for day in sorted(days):
        a, d = days[day].get("A"), days[day].get("D")
        if a and d:
            match("same_day", d, a)
        while waiting and (waiting[0]["left"] <= eps or waiting[0]["day"] < day - timedelta(days=30)):
            waiting.popleft()
        if a:
            for w in waiting:
                if a["left"] <= eps:
                    break
                if w["left"] > eps and w["day"] < day:
                    match("thirty_day", w, a)
        if d and d["left"] > eps:
            waiting.append(d)
    quantity = cost = Decimal(0)
    first = None  # the earliest day whose purchase entered the pool
    for day in sorted(days):
        a, d = days[day].get("A"), days[day].get("D")
        if a and a["left"] > eps:
            first = first or day
            quantity += a["left"]
            cost += a["value"] * a["left"] / a["q"]
        if d and d["left"] > eps:
            q = min(d["left"], quantity)
            if q > eps:
                c = cost * q / quantity
                rows.append((asset, "match", "section_104", day, d["id"], q, d["value"] * q / d["q"], c, None, None, None, None))
                quantity, cost = quantity - q, cost - c
                if quantity <= eps:
                    quantity = cost = Decimal(0)
            if (rest := d["left"] - max(q, Decimal(0))) > eps:
                rows.append((asset, "match", "unmatched", day, d["id"], rest, d["value"] * rest / d["q"], Decimal(0), None, None, None, None))
    if quantity > eps:
        rows.append((asset, "pool", None, None, None, None, None, None, None, quantity, cost, first))
    return rows


#: Rows go out in batches of about this many, of many assets each; a batch for each asset costs more than its fold.
BATCH = 8192


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds asset by asset what Spark sorted by asset; decimals go in and out as text."""
    getcontext().prec = 60  # quantities of 26 digits with 12 places, times values
    kinds = [pa.date32() if c.endswith(" date") else pa.string() for c in TEXTS.split(", ")]
    names = [c.split()[0] for c in TEXTS.split(", ")]

    def folded(rows: list[tuple]) -> pa.RecordBatch:
        cols = [[str(round(v, 12)) if isinstance(v, Decimal) else v for v in c] for c in zip(*rows, strict=True)] or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    asset, events, rows = None, [], []
    for b in batches:
        for name, *event in zip(*[b.column(c).to_pylist() for c in ("asset", "day", "kind", "quantity", "value", "ids")], strict=True):
            if events and name != asset:
                rows += _fold(asset, events)
                events = []
                if len(rows) >= BATCH:
                    yield folded(rows)
                    rows = []
            asset = name
            events.append(tuple(event))
    if events:
        rows += _fold(asset, events)
    yield folded(rows)


#: `ROWS` with decimals as text.
TEXTS = ROWS.replace("decimal(38,12)", "string")


def uk_engine(legs: DataFrame) -> DataFrame:
    """Match rows and closing pools, tagged by row_kind. An asset's fold has a step for each active UK day, not for each leg."""
    e = same_day_events(legs).select("asset", "day", "kind", F.col("quantity").cast("string").alias("quantity"), F.col("value").cast("string").alias("value"), "ids")
    rows = e.repartition(F.xxhash64("asset")).sortWithinPartitions("asset", "day").mapInArrow(_folds, TEXTS)
    return rows.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in ROWS.split(", ")])


def cgt_rows(engine: DataFrame) -> DataFrame:
    p, c = (F.round(F.col(x), 2) for x in ("proceeds", "cost"))
    return engine.where("row_kind = 'match'").select(
        "asset", "day", S.uk_tax_year(F.col("day")).alias("tax_year"), "match_type", "disposal_id", "acquisition_id", F.round("quantity", 8).alias("quantity"), p.alias("proceeds"), c.alias("cost"), (p - c).alias("gain")
    )


def cgt_by_year(rows: DataFrame) -> DataFrame:
    """Sums of the rounded rows by tax year, gains and losses apart, and what is taxable beyond the exempt amount."""
    g = rows.groupBy("tax_year").agg(
        F.countDistinct("asset", "disposal_id").alias("n_disposals"), F.sum("proceeds").alias("p"), F.sum("cost").alias("c"),
        F.sum(F.when(F.col("gain") > 0, F.col("gain")).otherwise(0)).alias("g"), F.sum(F.when(F.col("gain") < 0, -F.col("gain")).otherwise(0)).alias("l"),
    )
    net = F.col("g") - F.col("l")
    d = lambda c: c.cast("double")
    return g.select(
        "tax_year", "n_disposals", d(F.col("p")).alias("proceeds"), d(F.col("c")).alias("allowable_cost"), d(F.col("g")).alias("gains"), d(F.col("l")).alias("losses"), d(net).alias("net"),
        d(S.exempt_amount(F.col("tax_year"))).alias("exempt"), d(F.greatest(F.lit(0), net - S.exempt_amount(F.col("tax_year")))).alias("taxable"),
    )


def pools(engine: DataFrame) -> DataFrame:
    return engine.where("row_kind = 'pool'").select("asset", F.round("pool_quantity", 8).cast("double").alias("quantity"), F.round("pool_cost", 2).cast("double").alias("cost"))


def pool_details(engine: DataFrame) -> DataFrame:
    """Open pools with the earliest day whose purchase entered the pool, after matches of the same day and of 30 days."""
    return pools(engine).join(engine.where("row_kind = 'pool'").select("asset", F.col("first_day").alias("earliest_acquisition")), "asset")
