"""UK share matching over a stream of legs: same day, the following 30 days, then the pool, with timers that say when a row is final.

An asset keeps the legs of days that may still grow as a list, and a book: the pool, and the closed days whose shares aren't
settled yet, which are at most those of 30 days and the watermark's delay. When the watermark passes the end of a day, an event-time
timer closes it: matches of the day and with disposals of the 30 days before are final at once; a disposal's rest gets a provisional
row from the pool as it is known, and a final one when 30 more days are closed. Final rows are those of `plans.uk_cgt.uk_engine`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.session import compiled_only

DAY_MS = 86_400_000
WINDOW = 30
EPS = Decimal("1e-9")
EPOCH = date(1970, 1, 1)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "asset string, match_type string, day date, disposal_id string, acquisition_id string, quantity decimal(38,12), proceeds decimal(38,12), cost decimal(38,12), is_final boolean"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _side(legs: list[tuple]) -> dict | None:
    """The legs of one kind on one day as one; (day, kind, at, id, quantity, value) each."""
    if not legs:
        return None
    quantity, value = sum(Decimal(x[4]) for x in legs), sum(Decimal(x[5]) for x in legs)
    return {"q": quantity, "left": quantity, "value": value, "id": "+".join(x[3] for x in sorted(legs, key=lambda x: (x[2], x[3])))}


class Book:
    """The pool and the closed days that aren't settled, oldest first: [day, acquisitions, disposals]."""

    def __init__(self, asset: str, text: str | None):
        x = json.loads(text) if text else {"q": "0", "c": "0", "days": []}
        number = lambda s: None if s is None else {**s, "q": Decimal(s["q"]), "left": Decimal(s["left"]), "value": Decimal(s["value"])}
        self.asset, self.quantity, self.cost = asset, Decimal(x["q"]), Decimal(x["c"])
        self.days = [[d, number(a), number(b)] for d, a, b in x["days"]]
        self.rows: list[tuple] = []

    def text(self) -> str:
        return json.dumps({"q": self.quantity, "c": self.cost, "days": self.days}, default=str)

    def _row(self, kind: str, day: int, d: dict, q: Decimal, cost: Decimal, acquisition: str | None = None, final: bool = True) -> None:
        self.rows.append((self.asset, kind, EPOCH + timedelta(days=day), d["id"], acquisition, q, d["value"] * q / d["q"], cost, final))

    def _match(self, kind: str, day: int, d: dict, a: dict) -> None:
        q = min(d["left"], a["left"])
        d["left"] -= q
        a["left"] -= q
        self._row(kind, day, d, q, a["value"] * q / a["q"], a["id"])

    def close(self, day: int, a: dict | None, d: dict | None) -> None:
        if a and d:
            self._match("same_day", day, d, a)
        for then, _, w in self.days if a else ():
            if a["left"] <= EPS:
                break
            if w and w["left"] > EPS and day - WINDOW <= then < day:
                self._match("thirty_day", then, w, a)
        self.days.append([day, a, d])
        if d and d["left"] > EPS:
            held = self.quantity, self.cost
            for then, x, y in self.days:
                self._pool(then, x, y, final=False, say=then == day)
            self.quantity, self.cost = held

    def _pool(self, day: int, a: dict | None, d: dict | None, final: bool = True, say: bool = True) -> None:
        """The rest of a day's acquisitions goes into the pool, that of its disposals comes out of it."""
        if a and a["left"] > EPS:
            self.quantity += a["left"]
            self.cost += a["value"] * a["left"] / a["q"]
        if not d or d["left"] <= EPS:
            return
        q = min(d["left"], self.quantity)
        if q > EPS:
            cost = self.cost * q / self.quantity
            if say:
                self._row("section_104", day, d, q, cost, final=final)
            self.quantity, self.cost = self.quantity - q, self.cost - cost
            if self.quantity <= EPS:
                self.quantity = self.cost = Decimal(0)
        rest = d["left"] - max(q, Decimal(0))
        if rest > EPS and say:
            self._row("unmatched", day, d, rest, Decimal(0), final=final)

    def settle(self, closed: int) -> None:
        """Works off the days before the first disposal that a day after `closed` may still match."""
        while self.days and not ((d := self.days[0][2]) and d["left"] > EPS and self.days[0][0] + WINDOW > closed):
            self._pool(*self.days.pop(0))

    def due(self) -> int | None:
        """The day with whose close the oldest waiting disposal is final."""
        return self.days[0][0] + WINDOW if self.days else None


#: Assets share keys of the state: a call and a timer for each asset cost far more than its days. 2,048 keys hold some thousand assets each
#: where there are millions.
BUCKETS = 2048
LEG = "asset string, day int, kind string, at long, id string, quantity string, value string"


class ShareMatching(StatefulProcessor):
    """A key's assets: their open legs, the days with whose close waiting disposals are final, and a book for each, read when it's touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.legs = handle.getListState("legs", LEG)
        self.dues = handle.getListState("dues", "asset string, day int")
        self.books = handle.getMapState("books", "asset string", "text string")

    def _wake(self, day: int | None) -> None:
        if day is not None:
            self.handle.registerTimer((day + 1) * DAY_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            legs = [(r.asset, int(r.n), r.kind, int(r.at), r.id, r.q, r.v) for r in pdf.itertuples(index=False)]
            self.legs.appendList(legs)
            least = min(x[1] for x in legs)
            first = least if first is None else min(first, least)
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        legs, dues = list(self.legs.get()), dict(self.dues.get())
        rest = [x for x in legs if x[1] > closed]
        ready: dict[str | None, list[tuple]] = {asset: [] for asset, day in dues.items() if day <= closed}
        for asset, *leg in legs:
            if leg[0] <= closed:
                ready.setdefault(asset, []).append(tuple(leg))
        rows: list[tuple] = []
        for asset, mine in ready.items():
            book = self._closed(asset, mine, closed)
            rows += book.rows
            dues.pop(asset, None)
            if (due := book.due()) is not None:
                dues[asset] = due
        if len(rest) < len(legs):
            self.legs.put(rest) if rest else self.legs.clear()
        if ready:
            self.dues.put(list(dues.items())) if dues else self.dues.clear()
        self._wake(min([x[1] for x in rest] + list(dues.values()), default=None))
        out = pd.DataFrame(rows, columns=COLUMNS)
        for name in ("quantity", "proceeds", "cost"):
            out[name] = [round(x, 12) for x in out[name]]
        yield out

    def _closed(self, asset: str | None, legs: list[tuple], closed: int) -> Book:
        """The asset's book after the days up to `closed`."""
        name = ("" if asset is None else f"={asset}",)  # a key of the state can't be null
        kept = self.books.getValue(name)
        with localcontext() as c:
            c.prec = 60
            book = Book(asset, kept[0] if kept else None)
            days: dict[int, dict[str, list[tuple]]] = {}
            for x in legs:
                days.setdefault(x[0], {}).setdefault(x[1], []).append(x)
            for day in sorted(days):
                # What is final before a day opens must not wait for it: the pool is as of the days that are closed.
                book.settle(day - 1)
                book.close(day, _side(days[day].get("A", [])), _side(days[day].get("D", [])))
            book.settle(closed)
            self.books.updateValue(name, (book.text(),))
        return book


def share_matches(legs: DataFrame, delay: str = "2 days") -> DataFrame:
    """(asset, match_type, day, disposal_id, acquisition_id, quantity, proceeds, cost, is_final) of a stream of `plans.uk_cgt.uk_legs`.

    Legs over `delay` older than the newest are left out, as late. A disposal may have one provisional row, for what the pool gave as it
    was when its day closed; rows with is_final replace it. Null assets are one asset; rows without id, day or quantity are left out. Needs the state
    store `STATE_STORE` in spark.sql.streaming.stateStore.providerClass.
    """
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    x = legs.where("id is not null and day is not null and quantity > 0 and kind in ('A', 'D')").withWatermark("timestamp", delay)
    x = x.select("asset", "timestamp", day.alias("n"), "kind", F.unix_micros("timestamp").alias("at"), "id", F.col("quantity").cast("string").alias("q"), F.coalesce("value", F.lit(0)).cast("decimal(38,12)").cast("string").alias("v"))
    return x.withColumn("bucket", F.pmod(F.xxhash64("asset"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(statefulProcessor=ShareMatching(), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")


def replayed(spark: SparkSession, legs: DataFrame, folder: str, delay: str = "2 days") -> DataFrame:
    """All rows that the stream gives for a table of legs, written to `folder` and read from there file by file, with a last leg of no
    asset's far beyond the others, so that every timer fires."""
    one = spark.newSession()  # the state store's setting is the stream's own
    one.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    compiled_only(one)
    legs.write.parquet(f"{folder}/legs")
    end = legs.agg(F.max("timestamp").alias("t")).where("t is not null").select(F.lit("end").alias("id"), F.lit("").alias("asset"), (F.col("t") + F.expr("interval 400 days")).alias("timestamp"))
    end = end.select("id", "asset", "timestamp", F.to_date("timestamp").alias("day"), F.lit("A").alias("kind"), F.lit(1).cast("decimal(38,8)").alias("quantity"), F.lit(0).cast("decimal(38,12)").alias("value"))
    end.select(*legs.columns).write.mode("append").parquet(f"{folder}/legs")
    stream = one.readStream.schema(legs.schema).parquet(f"{folder}/legs")
    q = share_matches(stream, delay).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(ROWS).parquet(f"{folder}/rows")
