"""Lots by FIFO in closed form, by LIFO and HIFO as walks in order, and the US reports on them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..functions.spread import running
from ..operators.ledger_ops import with_rate


def lot_events(ledger: DataFrame, to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """Spot legs as lots (+) and disposals (-) in event order: time, trade group, lots first, id. Values and fees in the reporting currency.

    Derivatives, stablecoins, paired transfers and rows without quantity are left out; an unpaired transfer out is a disposal, one in a lot.
    Null fees and values count as 0.
    """
    t = F.col("transaction_type")
    transfer = (t == "TRANSFER") & F.col("transfer_pair_id").isNull()
    sign = F.when(t.isin(*S.ACQUISITIONS) | (transfer & (F.col("transfer_direction") == "IN")), 1).when(t.isin(*S.DISPOSALS) | (transfer & (F.col("transfer_direction") == "OUT")), -1)
    value, fee = (S.converted(F.col(c), F.col("fx_rate")) for c in ("fiat_value_at_trigger", "fee_fiat"))
    e = with_rate(ledger, to_ccy, rates).where(~S.is_perp(F.col("instrument_kind"), F.col("source")) & ~S.is_stable(F.col("asset"))).select(
        "id", "asset", "timestamp", F.coalesce("trade_group_id", F.lit("")).alias("gid"), sign.alias("sign"), S.units(F.col("amount")).alias("qty_u"),
        F.when(sign > 0, value + fee).when(t == "FEE", value).otherwise(value - fee).cast("decimal(38,0)").alias("value_c"),
    )
    return e.where("sign is not null and qty_u > 0")


def _prior(slices: DataFrame, keys: list[str], by: str, **what: Column) -> DataFrame:
    """For each slice of a key, aggregates over the slices before it."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(*keys, by, *[c.over(w).alias(n) for n, c in what.items()])


#: An asset with more legs than this is spread over many tasks; there are fewer such assets than the ledger has rows by this.
HOT_LEGS = 50_000


def fifo_matches(events: DataFrame, slice_by: str = "month", axis_slices: int = 64, hot_legs: int = HOT_LEGS) -> DataFrame:
    """Matches of disposals to lots, first in first out; what no lot covers has lot_id null and cost 0.

    Assets of at most `hot_legs` legs are dealt once, by asset, and all their sorts are in place; only those with more are cut into
    slices, which deals their rows several times. Rows without an asset or a time are left out.
    """
    cold, hot = _by_heat(events.where("asset is not null and timestamp is not null"), hot_legs)
    return _fifo_by_asset(cold) if hot is None else _fifo_by_asset(cold).unionByName(_fifo_by_slices(hot, slice_by, axis_slices))


def _by_heat(e: DataFrame, hot_legs: int) -> tuple[DataFrame, DataFrame | None]:
    """Events of assets with at most `hot_legs` legs, and those of the others, if there are any."""
    hot = cut(e.groupBy("asset").count().where(F.col("count") > hot_legs).select("asset"))
    if hot.isEmpty():
        return e, None
    return e.join(F.broadcast(hot), "asset", "left_anti"), e.join(F.broadcast(hot), "asset", "left_semi")


def _fifo_by_asset(events: DataFrame) -> DataFrame:
    """The matches of `_fifo_by_slices` with windows over whole assets, on one dealing of the rows, which are read and sorted once for both kinds of match."""
    s = _stretches(events, ("id", "timestamp", "qty_u", "value_c")).withColumn("q", _taken())
    both = F.array(F.when(_is_covered(), F.struct("asset", *_covered_part())), F.when(F.col("own").isNotNull(), F.struct("asset", *_bare_part("own."))))
    return s.select(F.explode(F.array_compact(both)).alias("m")).select("m.*")


def _stretches(events: DataFrame, of_out: tuple[str, ...] = ()) -> DataFrame:
    """The stretches (asset, pos, lot, out, next, own) of each asset's axis, dealt by asset; `own` is the row that begins one, if no lot covers part of it.

    Disposals that no lot covers at all come first, without a lot; they take nothing of the axis. `of_out`: what is wanted of disposals besides their end.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    w = Window.partitionBy("asset").orderBy("timestamp", "gid", F.col("sign").desc(), "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("net", dec(F.sum(F.col("sign") * F.col("qty_u")).over(run)))
    e = e.withColumn("u", dec(F.greatest(F.lit(0), -F.min("net").over(run))))
    bare = dec(F.when(F.col("sign") < 0, F.col("u") - F.coalesce(F.lag("u").over(w), F.lit(0))).otherwise(0))
    d = e.withColumn("bare", bare).withColumn("len", dec(F.col("qty_u") - F.col("bare"))).drop("net", "u")
    # Lots and disposals each lie end to end, in the order of the same sort.
    lots, outs = (F.sum(F.when(side, F.col("len")).otherwise(0)).over(run) for side in (F.col("sign") > 0, F.col("sign") < 0))
    d = d.withColumn("end", dec(F.when(F.col("sign") > 0, lots).otherwise(outs))).withColumn("pos", dec(F.col("end") - F.col("len")))
    live = F.col("len") > 0
    lot, out = F.when(live & (F.col("sign") > 0), F.struct("id", "timestamp", "qty_u", "value_c", "end")), F.when(live & (F.col("sign") < 0), F.struct(*of_out, "end"))
    d = d.select("asset", "pos", "sign", live.alias("live"), lot.alias("lot"), out.alias("out"), F.when(F.col("bare") > 100, F.struct("id", "timestamp", "qty_u", "value_c", "bare")).alias("own"))
    o = Window.partitionBy("asset").orderBy("live", "pos", "sign")
    seen = o.rowsBetween(Window.unboundedPreceding, 0)
    return d.select("asset", "pos", F.last("lot", True).over(seen).alias("lot"), F.last("out", True).over(seen).alias("out"), F.lead("pos").over(o).alias("next"), "own")


def _taken() -> Column:
    """Quantity of a stretch that its disposal takes from its lot."""
    return (F.least("next", "lot.end", "out.end") - F.col("pos")).cast("decimal(38,0)")


def _is_covered() -> Column:
    return F.col("lot").isNotNull() & F.col("out").isNotNull() & (F.col("q") > F.lit(100))


def _covered_part() -> list[Column]:
    """A match but for its asset, of a stretch (lot, out, q)."""
    return [
        F.col("out.id").alias("disposal_id"), F.col("lot.id").alias("lot_id"), F.col("lot.timestamp").alias("acquired"), F.col("out.timestamp").alias("disposed"), F.col("q").alias("qty_u"),
        S.share(F.col("out.value_c"), F.col("q"), F.col("out.qty_u")).alias("proceeds_c"), S.share(F.col("lot.value_c"), F.col("q"), F.col("lot.qty_u")).alias("cost_c"),
    ]


def _bare_part(at: str = "") -> list[Column]:
    """A match but for its asset, of what no lot covers of a disposal."""
    c = lambda n: F.col(at + n)
    return [
        c("id").alias("disposal_id"), F.lit(None).cast("string").alias("lot_id"), F.lit(None).cast("timestamp").alias("acquired"), c("timestamp").alias("disposed"), c("bare").alias("qty_u"),
        S.share(c("value_c"), c("bare"), c("qty_u")).alias("proceeds_c"), F.lit(0).cast("decimal(38,0)").alias("cost_c"),
    ]


def _covered(s: DataFrame) -> DataFrame:
    """Matches from stretches (asset, pos, lot, out, next) of the axis."""
    return s.withColumn("q", _taken()).where(_is_covered()).select("asset", *_covered_part())


def _uncovered(d: DataFrame) -> DataFrame:
    """What no lot covers of the disposals."""
    return d.where("bare > 100").select("asset", *_bare_part())


def _fifo_by_slices(events: DataFrame, slice_by: str, axis_slices: int) -> DataFrame:
    """Matches of disposals to lots.

    Lots lie end to end on an axis of quantity, and so do the covered parts of disposals; the uncovered quantity so far is how
    far the running balance has been below zero. Both kinds of interval are merged by their begin, and each stretch to the next
    begin takes the lot and disposal seen last: sorts, never lots times disposals.

    No window holds a whole asset: running sums are cut into slices of time, the merge into slices of the axis, and each slice starts from
    what the ones before it hand on, aggregated to a row for each slice. `slice_by` (a unit of date_trunc) and `axis_slices` (for each
    asset) set how finely a hot asset is spread.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    zero = dec(F.lit(0))
    e = events.withColumn("cut", F.date_trunc(slice_by, "timestamp"))
    w = Window.partitionBy("asset", "cut").orderBy("timestamp", "gid", F.col("sign").desc(), "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = cut(e.withColumn("inner", dec(F.sum(F.col("sign") * F.col("qty_u")).over(run))))
    totals = e.groupBy("asset", "cut").agg(dec(F.sum(F.col("sign") * F.col("qty_u"))).alias("sum"), F.min("inner").alias("low"))
    before = _prior(totals, ["asset"], "cut", base=F.sum("sum"))
    lows = totals.join(before, ["asset", "cut"]).select("asset", "cut", dec(F.coalesce("base", zero)).alias("base"), dec(F.coalesce("base", zero) + F.col("low")).alias("low"))
    floor = lows.join(_prior(lows, ["asset"], "cut", floor=F.min("low")), ["asset", "cut"]).select("asset", "cut", "base", dec(F.least(zero, F.coalesce("floor", zero))).alias("floor"))
    e = e.join(floor, ["asset", "cut"]).withColumn("u", dec(-F.least("floor", F.col("base") + F.min("inner").over(run))))
    bare = F.col("u") - F.coalesce(F.lag("u").over(w), -F.col("floor"))
    d = e.withColumn("bare", dec(F.when(F.col("sign") < 0, bare).otherwise(0))).withColumn("len", dec(F.col("qty_u") - F.col("bare")))
    d = cut(d.drop("inner", "base", "floor", "u"))
    ends = d.groupBy("asset", "sign", "cut").agg(dec(F.sum("len")).alias("sum"))
    ends = _prior(ends, ["asset", "sign"], "cut", start=F.sum("sum"))
    inside = Window.partitionBy("asset", "cut", "sign").orderBy("timestamp", "gid", "id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(ends, ["asset", "sign", "cut"]).withColumn("end", dec(F.coalesce("start", zero) + F.sum("len").over(inside))).withColumn("pos", dec(F.col("end") - F.col("len")))
    d = cut(d)

    it = F.struct("id", "timestamp", "qty_u", "value_c", "end")
    width = d.where("sign > 0").groupBy("asset").agg(F.greatest(F.lit(1.0), F.sum("len").cast("double") / axis_slices).alias("width"))
    starts = d.where("len > 0").join(width, "asset").select("asset", F.floor(F.col("pos").cast("double") / F.col("width")).alias("part"), "pos", "sign", F.when(F.col("sign") > 0, it).alias("lot"), F.when(F.col("sign") < 0, it).alias("out"))
    parts = starts.groupBy("asset", "part").agg(F.max_by("lot", F.when(F.col("sign") > 0, F.col("pos"))).alias("lot"), F.max_by("out", F.when(F.col("sign") < 0, F.col("pos"))).alias("out"), F.min("pos").alias("first"))
    given = _prior(parts, ["asset"], "part", lot0=F.last("lot", True), out0=F.last("out", True))
    after = Window.partitionBy("asset").orderBy("part")
    given = given.join(parts.select("asset", "part", F.lead("first").over(after).alias("next0")), ["asset", "part"])
    o = Window.partitionBy("asset", "part").orderBy("pos", "sign")
    seen = o.rowsBetween(Window.unboundedPreceding, 0)
    s = starts.join(given, ["asset", "part"]).select(
        "asset", "pos", F.coalesce(F.last("lot", True).over(seen), F.col("lot0")).alias("lot"), F.coalesce(F.last("out", True).over(seen), F.col("out0")).alias("out"), F.coalesce(F.lead("pos").over(o), F.col("next0")).alias("next")
    )
    return _covered(s).unionByName(_uncovered(d))


def _half_up(total: int, part: int, whole: int) -> int:
    q = (2 * abs(total) * part + whole) // (2 * whole)
    return q if total >= 0 else -q


#: Unit costs are compared as whole multiples of 2^-256: quantities have under 127 bits, so different ones stay apart, equal ones equal.
UNIT_BITS = 256
NEVER = 1 << 62  # the time of rows without one, which come last
PICKED = "asset string, disposal_id string, lot_id string, acquired long, disposed long, qty_u string, proceeds_c string, cost_c string"


def _picker(method: str):
    """Walks events sorted by asset and time, batch by batch; of an asset only the open lots are held, in a heap with the one to take next on top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asset: object = batches  # no asset yet
        lots: list[tuple] = []
        seen = 0
        for b in batches:
            out = []
            for name, sign, ident, at, qty, worth in zip(*[b.column(c).to_pylist() for c in ("asset", "sign", "id", "at", "q", "v")], strict=True):
                if name != asset:
                    asset, lots, seen = name, [], 0
                q, value = int(qty), int(worth)
                if sign > 0:
                    unit = -((value << UNIT_BITS) // q)
                    heapq.heappush(lots, ((-at, unit, seen) if method == "LIFO" else (unit, at, seen), [ident, at, q, q, value]))
                    seen += 1
                    continue
                need = q
                while need > 100 and lots:
                    lot = lots[0][1]
                    take = min(need, lot[3])
                    out.append((name, ident, lot[0], lot[1], at, take, _half_up(value, take, q), _half_up(lot[4], take, lot[2])))
                    need -= take
                    lot[3] -= take
                    if lot[3] <= 100:
                        heapq.heappop(lots)
                if need > 100:
                    out.append((name, ident, None, None, at, need, _half_up(value, need, q), 0))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [pa.array(map(str, c), pa.string()) for c in cols[5:]], [c.split()[0] for c in PICKED.split(", ")])

    return run


def picked_matches(events: DataFrame, method: str) -> DataFrame:
    """LIFO and HIFO choose among the open lots at each disposal, so each asset is walked in order, in a stream that Spark sorts."""
    order = [F.col("timestamp").asc_nulls_last(), F.col("gid"), F.col("sign").desc(), F.col("id")]
    at = F.coalesce(F.unix_micros("timestamp"), F.lit(NEVER))
    x = events.repartition(F.xxhash64("asset")).sortWithinPartitions("asset", *order).select("asset", "sign", "id", at.alias("at"), F.col("qty_u").cast("string").alias("q"), F.col("value_c").cast("string").alias("v"))
    when = lambda c: F.when(F.col(c) < NEVER, F.timestamp_micros(c)).alias(c)
    number = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("qty_u", "proceeds_c", "cost_c")]
    return x.mapInArrow(_picker(method), PICKED).select("asset", "disposal_id", "lot_id", when("acquired"), when("disposed"), *number)


def matches(ledger: DataFrame, method: str = "FIFO", to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    e = lot_events(ledger, to_ccy, rates)
    return fifo_matches(e) if method == "FIFO" else picked_matches(e, method)


def form_8949(m: DataFrame) -> DataFrame:
    """One row per match with its term; what no lot covers is SHORT with unknown acquisition."""
    return m.select(
        "asset", "disposal_id", "lot_id", F.to_date("acquired").alias("date_acquired"), F.to_date("disposed").alias("date_sold"), S.quantity(F.col("qty_u")).alias("quantity"),
        S.money(F.col("proceeds_c")).alias("proceeds"), S.money(F.col("cost_c")).alias("cost_basis"), S.money(F.col("proceeds_c") - F.col("cost_c")).alias("gain_loss"),
        F.when(F.col("acquired").isNull(), "SHORT").otherwise(S.holding_term(F.col("acquired"), F.col("disposed"))).alias("term"),
    )


def realized_by_asset(m: DataFrame) -> DataFrame:
    g = m.groupBy("asset").agg(F.count("*").alias("n_rows"), F.sum("qty_u").alias("q"), F.sum("proceeds_c").alias("p"), F.sum("cost_c").alias("c"))
    pnl = F.col("p") - F.col("c")
    pct = F.when(F.col("c") > 0, F.round((pnl * 10000 / F.col("c")).cast("decimal(38,6)"), 0) / 100).otherwise(0)
    return g.select("asset", "n_rows", S.quantity(F.col("q")).alias("quantity"), S.money(F.col("p")).alias("proceeds"), S.money(F.col("c")).alias("cost_basis"), S.money(pnl).alias("realized_pnl"), pct.cast("double").alias("realized_pct"))


def realized_by_year_term(m: DataFrame, subtotals: bool = False) -> DataFrame:
    """Sums by UTC year of disposal and term; with subtotals also by year and in all."""
    term = F.when(F.col("acquired").isNull(), "SHORT").otherwise(S.holding_term(F.col("acquired"), F.col("disposed")))
    x = m.select(F.year("disposed").alias("year"), term.alias("term"), "proceeds_c", "cost_c")
    g = (x.rollup("year", "term") if subtotals else x.groupBy("year", "term")).agg(F.sum("proceeds_c").alias("p"), F.sum("cost_c").alias("c"), F.count("*").alias("n_rows"))
    return g.select("year", "term", "n_rows", S.money(F.col("p")).alias("proceeds"), S.money(F.col("c")).alias("cost_basis"), S.money(F.col("p") - F.col("c")).alias("gain_loss"))


def open_lots(events: DataFrame, m: DataFrame) -> DataFrame:
    """Lots with what is left of them, down to 1e-6."""
    used = m.where("lot_id is not null").groupBy("lot_id").agg(F.sum("qty_u").alias("used"))
    return _left(events.where("sign > 0").join(used, F.col("id") == F.col("lot_id"), "left"))


def _left(x: DataFrame) -> DataFrame:
    """Lots of which more than 1e-6 is left, from lots with what is used of them."""
    left = (F.col("qty_u") - F.coalesce("used", F.lit(0))).cast("decimal(38,0)")
    x = x.withColumn("left", left).where("left > 100")
    return x.select("asset", "id", "timestamp", F.col("left").alias("qty_u"), S.share(F.col("value_c"), F.col("left"), F.col("qty_u")).alias("cost_c"))


def fifo_open_lots(events: DataFrame, hot_legs: int = HOT_LEGS) -> DataFrame:
    """`open_lots` by `fifo_matches`, summed where the matches are made: the events are dealt once, by asset, and no match meets its lot again.

    Every lot begins a stretch of its own, so the stretches have all lots. Lots without an asset or a time are matched with nothing and stay whole;
    assets of more than `hot_legs` legs take the way by matches.
    """
    timed = "asset is not null and timestamp is not null"
    cold, hot = _by_heat(events.where(timed), hot_legs)
    x = _stretches(cold).where("lot is not null").withColumn("q", _taken())
    x = x.groupBy("asset", F.col("lot.id").alias("id"), F.col("lot.end").alias("end")).agg(
        F.first("lot.timestamp").alias("timestamp"), F.first("lot.qty_u").alias("qty_u"), F.first("lot.value_c").alias("value_c"), F.sum(F.when(_is_covered(), F.col("q"))).alias("used")
    )
    loose = events.where(f"sign > 0 and not ({timed})").select("asset", "id", "timestamp", "qty_u", "value_c", F.lit(None).cast("decimal(38,0)").alias("used"))
    out = _left(x.drop("end").unionByName(loose))
    return out if hot is None else out.unionByName(open_lots(hot, _fifo_by_slices(hot, "month", 64)))


def positions(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Quantity, invested, value and unrealized gain by asset; prices (asset, price), an asset without one has value null."""
    g = lots.groupBy("asset").agg(F.sum("qty_u").alias("q"), F.sum("cost_c").alias("c"), F.count("*").alias("n_lots"), F.min("timestamp").alias("first_acquired"))
    g = g.join(prices, "asset", "left").withColumn("v", F.round(F.col("q") * F.col("price").cast("decimal(18,4)") / 1000000, 0).cast("decimal(38,0)"))
    return g.select("asset", "n_lots", "first_acquired", S.quantity(F.col("q")).alias("quantity"), S.money(F.col("c")).alias("invested"), S.money(F.col("v")).alias("market_value"), S.money(F.col("v") - F.col("c")).alias("unrealized"))


def harvest_uk(pos: DataFrame, band: float = 37700.0, basic: float = 0.18, higher: float = 0.24) -> DataFrame:
    """Losses from the largest; each fills what is left of the unused basic-rate band first."""
    x = pos.where("unrealized < 0").select("asset", (-F.col("unrealized")).cast("decimal(20,2)").alias("loss"))
    x = running(cut(x), [F.col("loss").desc(), F.col("asset")], before="loss")
    x = x.withColumn("at_basic", F.least("loss", F.greatest(F.lit(band).cast("decimal(20,2)") - F.col("before"), F.lit(0))).cast("decimal(20,2)"))
    save = F.round(F.col("at_basic") * F.lit(basic).cast("decimal(4,2)") + (F.col("loss") - F.col("at_basic")) * F.lit(higher).cast("decimal(4,2)"), 2)
    return x.select("asset", F.col("loss").cast("double").alias("loss"), F.col("at_basic").cast("double").alias("at_basic"), save.cast("double").alias("tax_saved"))


def harvest_us(lots: DataFrame, prices: DataFrame, as_of, ordinary: float = 0.24, long_term: float = 0.15) -> DataFrame:
    """Unrealized gain of open lots by term on the day `as_of`, and the tax a sale would cost (negative: save)."""
    v = F.round(F.col("qty_u") * F.col("price").cast("decimal(18,4)") / 1000000, 0).cast("decimal(38,0)")
    x = lots.join(prices, "asset").select("asset", (v - F.col("cost_c")).alias("g"), S.holding_term(F.col("timestamp"), F.lit(as_of).cast("timestamp")).alias("term"))
    g = x.groupBy("asset").agg(F.sum(F.when(F.col("term") == "SHORT", F.col("g")).otherwise(0)).alias("s"), F.sum(F.when(F.col("term") == "LONG", F.col("g")).otherwise(0)).alias("l"))
    tax = F.round((F.col("s") * int(ordinary * 100) + F.col("l") * int(long_term * 100)) / 100, 0)
    return g.select("asset", S.money(F.col("s")).alias("short_term"), S.money(F.col("l")).alias("long_term"), S.money(tax).alias("tax_if_sold"), S.money(F.greatest(-tax, F.lit(0))).alias("tax_saved"))
