"""Greedy one-to-one pairing of legs: candidates by join on the closest key, the choice inside it in order."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

HOURS = 3600.0
# Marks of an earn account's deposits and withdrawals in the ids of an import.
EARN_OUT = r"crypto_earn_program_(created|deposit)"
EARN_IN = "crypto_earn_program_withdrawn"
EARN_DAYS = 400


def transfer_candidates(ledger: DataFrame, window_hours: float = 48) -> DataFrame:
    """Transfers out and in of one asset at different venues, close in time and amount, with their score.

    Time is cut into buckets of the window's length, and each leg meets only legs of its own and the neighbouring buckets.
    """
    t = ledger.where("transaction_type = 'TRANSFER' and transfer_pair_id is null and amount > 0").withColumn("at", F.unix_micros("timestamp") / 1e6)
    size = window_hours * HOURS
    out = t.where("transfer_direction = 'OUT'").select("asset", F.col("id").alias("out_id"), F.col("source").alias("out_source"), F.col("at").alias("out_at"), F.col("amount").alias("out_amount"), F.floor(F.col("at") / size).alias("bucket"))
    into = t.where("transfer_direction = 'IN'").select("asset", F.col("id").alias("in_id"), F.col("source").alias("in_source"), F.col("at").alias("in_at"), F.col("amount").alias("in_amount"), F.floor(F.col("at") / size).alias("b"))
    into = into.withColumn("bucket", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).drop("b")
    fee = F.col("out_amount") - F.col("in_amount")
    ok = (
        (F.coalesce(F.col("out_source") != F.col("in_source"), F.lit(True))) & (F.abs(F.col("in_at") - F.col("out_at")) <= size) & (F.col("in_amount") <= F.col("out_amount") * 1.0005)
        & (fee <= F.greatest(F.col("out_amount") * 0.01, F.lit(1e-8))) & (fee <= F.col("out_amount") * 0.02)
    )
    score = F.abs(fee) * 1e6 + F.abs(F.col("in_at") - F.col("out_at"))
    return out.join(into, ["asset", "bucket"]).where(ok).select("asset", "out_id", "in_id", "out_at", "in_at", score.alias("score"))


def _walk(keys: list[str], seconds: float | None):
    """Walks candidates in order of their key, leg out and score, and keeps of an asset only the legs in that a later leg out can still meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = out = None
        used: set[str] = set()
        ages: list[tuple[float, str]] = []
        done = False
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                now = tuple(getattr(r, k) for k in keys)
                if now != key:
                    key, out, used, ages = now, None, set(), []
                if (r.out_at, r.out_id) != out:
                    out, done = (r.out_at, r.out_id), False
                    while seconds is not None and ages and ages[0][0] < r.out_at - seconds:
                        used.discard(heapq.heappop(ages)[1])
                if not done and r.in_id not in used:
                    done = True
                    used.add(r.in_id)
                    heapq.heappush(ages, (r.in_at, r.in_id))
                    rows.append((r.asset, r.out_id, r.in_id, "pair-" + r.out_id))
            yield pd.DataFrame(rows, columns=["asset", "out_id", "in_id", "pair_id"])

    return run


def assigned(candidates: DataFrame, *keys: str, seconds: float | None = None) -> DataFrame:
    """(asset, out_id, in_id, pair_id): within each key, each leg out, in order of time, takes the unused leg in of least score.

    Spark sorts the candidates (asset, out_id, in_id, out_at, in_at, score) and a task walks them once, batch by batch, so a key with a third of all
    candidates takes long but no memory. `seconds` bounds how far the legs of a candidate lie apart.

    Rows are dealt by a hash of the key: by the key itself, Spark takes the dealing of a join on the same columns for it, which it may give up when
    it makes that join a broadcast at run time, and then a key lies in several tasks.
    """
    names = [*dict.fromkeys([*keys, "asset", "out_id", "in_id", "out_at", "in_at", "score"])]
    x = candidates.select(*names).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "out_at", "out_id", "score", "in_id")
    return x.mapInPandas(_walk(list(keys), seconds), "asset string, out_id string, in_id string, pair_id string")


class _Window:
    """The unused legs in of one key that a leg out can still take, in queues by amount and mark, each in order of time."""

    def __init__(self, before: float, after: float, tolerance: float | None, other: bool):
        self.before, self.after, self.tolerance, self.other = before, after, tolerance, other
        self.amounts: list[float] = []
        self.queues: dict[float, dict[str, deque]] = {}
        self.order: deque = deque()
        self.used: set[str] = set()

    def put(self, at: float, ident: str, amount: float, mark: str) -> None:
        if amount not in self.queues:
            insort(self.amounts, amount)
            self.queues[amount] = {}
        self.queues[amount].setdefault(mark, deque()).append((at, ident))
        self.order.append((at, ident, amount, mark))

    def _pop(self, amount: float, mark: str) -> None:
        marks = self.queues[amount]
        marks[mark].popleft()
        if not marks[mark]:
            del marks[mark]
            if not marks:
                del self.queues[amount]
                del self.amounts[bisect_left(self.amounts, amount)]

    def take(self, at: float, amount: float, mark: str) -> str | None:
        """The earliest leg in that fits a leg out; legs out come in order of time."""
        while self.order and at - self.order[0][0] > self.before:
            t, ident, a, m = self.order.popleft()
            self.used.discard(ident)
            if (q := self.queues.get(a, {}).get(m)) and q[0] == (t, ident):
                self._pop(a, m)
        near = self.amounts
        if self.tolerance is not None:
            span = 2 * self.tolerance * abs(amount) if self.tolerance < 0.5 else float("inf")
            i = bisect_left(near, amount - span)
            near = near[i : bisect_left(near, amount + span, i) + 1]
            near = [a for a in near if abs(a - amount) <= max(a, amount) * self.tolerance]
        best = None
        for a in list(near):
            for m in [*self.queues[a]]:
                if m == mark if self.other else bool(mark and m and m != mark):
                    continue
                while (q := self.queues.get(a, {}).get(m)) and q[0][1] in self.used:
                    self._pop(a, m)
                if q and q[0][0] - at <= self.after and (best is None or q[0] < best[0]):
                    best = (q[0], a, m)
        if best is None:
            return None
        (_, ident), a, m = best
        self.used.add(ident)
        self._pop(a, m)
        return ident


def _walk_legs(before: float, after: float, tolerance: float | None, other: bool):
    """Walks legs in order of key and time. A leg out waits until no leg in that it may take can come; of a key only the window's legs are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = batches  # no key yet
        waits: deque = deque()
        legs = _Window(before, after, tolerance, other)
        last = None
        for pdf in batches:
            rows: list[tuple] = []
            for asset, ident, at, amount, mark, out in zip(*[pdf[c].tolist() for c in ("asset", "id", "at", "amount", "mark", "out")], strict=True):
                if asset != key:
                    rows += _settle(key, waits, legs, None)
                    key, legs, last = asset, _Window(before, after, tolerance, other), None
                rows += _settle(key, waits, legs, at)
                if (at, ident, out) == last:
                    continue
                last = (at, ident, out)
                if out:
                    waits.append((at, ident, amount, mark))
                else:
                    legs.put(at, ident, amount, mark)
            yield pd.DataFrame(rows, columns=["asset", "out_id", "in_id", "pair_id"])
        yield pd.DataFrame(_settle(key, waits, legs, None), columns=["asset", "out_id", "in_id", "pair_id"])

    return run


def _settle(key: object, waits: deque, legs: _Window, now: float | None) -> list[tuple]:
    """Pairs of the legs out that no leg in from `now` on can fit; of all, if no time is given."""
    rows = []
    while waits and (now is None or now - waits[0][0] > legs.after):
        at, ident, amount, mark = waits.popleft()
        if (got := legs.take(at, amount, mark)) is not None:
            rows.append((key, ident, got, f"pair-{ident}"))
    return rows


def earliest(out: DataFrame, into: DataFrame, before: float, after: float, tolerance: float | None = None, other: bool = False) -> DataFrame:
    """(asset, out_id, in_id, pair_id): of each asset each leg out, in order of time, takes the earliest unused leg in from `before` seconds before
    to `after` seconds after it, of an amount within `tolerance`, or of any.

    Legs: asset, id, at (seconds), amount, mark. Marks must differ with `other`, else they must not contradict each other (empty ones agree with
    all). The legs are dealt by asset, sorted by Spark and walked once; candidates, whose number grows with the square of an asset's
    legs, are never made. Rows with a null asset, id, time, amount or mark have no pair.
    """
    size = F.lit(0.0) if tolerance is None else F.col("amount")
    side = lambda df, way: df.select("asset", "id", "at", size.cast("double").alias("amount"), "mark", F.lit(way).alias("out"))
    x = side(out, True).unionByName(side(into, False)).where("asset is not null and id is not null and at is not null and amount is not null and mark is not null and not isnan(amount)")
    x = x.repartition(F.xxhash64("asset")).sortWithinPartitions("asset", "at", "id", "out")
    return x.mapInPandas(_walk_legs(before, after, tolerance, other), "asset string, out_id string, in_id string, pair_id string")


class _Line:
    """Unused legs in of one amount and mark, by time, those of one time by id. A time without any is stepped over by links to the next that has some, either way."""

    def __init__(self) -> None:
        self.times: list[float] = []
        self.ids: list[deque] = []
        self.later: list[int] = []
        self.sooner: list[int] = []
        self.begin = 0
        self.left = 0

    def put(self, at: float, ident: str) -> None:
        if not self.times or self.times[-1] != at:
            n = len(self.times)
            self.times.append(at)
            self.ids.append(deque())
            self.later.append(n)
            self.sooner.append(n)
        self.ids[-1].append(ident)
        self.left += 1

    @staticmethod
    def _end(links: list[int], i: int) -> int:
        """Follows links from `i` to a time that has legs, or beyond the ends, and shortens the way."""
        j = i
        while 0 <= j < len(links) and links[j] != j:
            j = links[j]
        while i != j:
            links[i], i = j, links[i]
        return j

    def pop(self, i: int) -> None:
        self.ids[i].popleft()
        self.left -= 1
        if not self.ids[i]:
            self.later[i], self.sooner[i] = i + 1, i - 1

    def around(self, at: float, before: float, after: float, away: float, used: set[str]) -> tuple[float, str, int] | None:
        """(score, id, place) of the best leg for one at `at`; `away` is what the amounts add to the score."""
        best = None
        middle = bisect_left(self.times, at, self.begin)
        for start, links, step, most in ((middle, self.later, 1, after), (middle - 1, self.sooner, -1, before)):
            i = self._end(links, start)
            while self.begin <= i < len(self.times) and abs(self.times[i] - at) <= most:
                while self.ids[i] and self.ids[i][0] in used:
                    self.pop(i)
                if self.ids[i]:
                    found = (away + abs(self.times[i] - at), self.ids[i][0], i)
                    if best is not None and found[0] > best[0]:
                        break  # scores don't fall with distance; equal ones come of rounding
                    if best is None or found < best:
                        best = found
                i = self._end(links, i + step)
        return best

    def forget(self, at: float, before: float) -> None:
        """Drops times over `before` seconds before `at`."""
        while self.begin < len(self.times) and at - self.times[self.begin] > before:
            self.left -= len(self.ids[self.begin])
            self.ids[self.begin] = deque()
            self.begin += 1
        if self.begin > 1000 and 2 * self.begin > len(self.times):
            self.times, self.ids, self.begin = self.times[self.begin :], self.ids[self.begin :], 0
            self.later = [i if x else i + 1 for i, x in enumerate(self.ids)]
            self.sooner = [i if x else i - 1 for i, x in enumerate(self.ids)]


class Nearest:
    """The unused legs in of one key that a leg out can still take. A leg out looks at the nearest in time of each amount that fits, so candidates,
    whose number grows with the square of a key's legs, are never made."""

    def __init__(self, before: float, after: float, other: bool):
        self.before, self.after, self.other = before, after, other
        self.amounts: list[float] = []
        self.lines: dict[float, dict[str | None, _Line]] = {}
        self.order: deque = deque()
        self.used: set[str] = set()

    def put(self, at: float, ident: str, amount: float, mark: str | None) -> None:
        if amount not in self.lines:
            insort(self.amounts, amount)
            self.lines[amount] = {}
        self.lines[amount].setdefault(mark, _Line()).put(at, ident)
        if self.before != float("inf"):
            self.order.append((at, ident, amount, mark))

    def _tidy(self, amount: float, mark: str | None) -> None:
        """Forgets a line without legs."""
        marks = self.lines[amount]
        if not marks[mark].left:
            del marks[mark]
            if not marks:
                del self.lines[amount]
                del self.amounts[bisect_left(self.amounts, amount)]

    def take(self, at: float, amounts: Sequence[tuple[float, str | None]]) -> str | None:
        """The leg in of least score, of equal ones the least id, for a leg out of such amounts and marks (of one, but for repeated rows); legs out come in order of time."""
        while self.order and at - self.order[0][0] > self.before:
            _, ident, a, m = self.order.popleft()
            self.used.discard(ident)
            if line := self.lines.get(a, {}).get(m):
                line.forget(at, self.before)
                self._tidy(a, m)
        best: tuple | None = None
        for amount, mark in amounts:
            i = bisect_left(self.amounts, amount)
            for near in (range(i, len(self.amounts)), range(i - 1, -1, -1)):
                for j in near:
                    a = self.amounts[j]
                    away = abs(amount - a) * 1e6
                    if not fits(amount, a) or (best is not None and away > best[0][0]):
                        break
                    for m, line in self.lines[a].items():
                        if self.other and m == mark and m is not None:
                            continue
                        got = line.around(at, self.before, self.after, away, self.used)
                        if got is not None and (best is None or got[:2] < best[0][:2]):
                            best = (got, a, m)
        if best is None:
            return None
        (_, ident, i), a, m = best
        self.lines[a][m].pop(i)
        self._tidy(a, m)
        self.used.add(ident)
        return ident


def fits(out_amount: float, in_amount: float) -> bool:
    """Whether a leg in may be what a leg out sent, less a fee."""
    fee = out_amount - in_amount
    return in_amount <= out_amount * 1.0005 and fee <= max(out_amount * 0.01, 1e-8) and fee <= out_amount * 0.02


def chosen(waits: deque, legs: Nearest, now: float | None) -> Iterator[tuple[str, str]]:
    """(out_id, in_id) of the legs out, (at, id, amount, mark) in order of time, that no leg in from `now` on can fit; of all, if no time is given."""
    while waits and (now is None or now - waits[0][0] > legs.after):
        at, ident = waits[0][:2]
        amounts = []
        while waits and waits[0][:2] == (at, ident):
            amounts.append(waits.popleft()[2:])
        if (got := legs.take(at, amounts)) is not None:
            yield ident, got


def _walk_nearest(keys: list[str], before: float, after: float, other: bool):
    """Walks legs in order of key and time. A leg out waits until no leg in that it may take can come; of a key only the window's legs are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        coin = ""
        waits: deque = deque()
        legs = Nearest(before, after, other)
        last = None
        pairs = lambda now: [(coin, o, i, f"pair-{o}") for o, i in chosen(waits, legs, now)]
        for pdf in batches:
            rows: list[tuple] = []
            names = zip(*[pdf[k].tolist() for k in keys], strict=True)
            for own, asset, ident, at, amount, mark, out in zip(names, *[pdf[c].tolist() for c in ("asset", "id", "at", "amount", "mark", "out")], strict=True):
                if own != key:
                    rows += pairs(None)
                    key, coin, legs, last = own, asset, Nearest(before, after, other), None
                if waits:
                    rows += pairs(at)
                if (at, ident, amount, mark, out) == last:
                    continue
                last = (at, ident, amount, mark, out)
                if out:
                    waits.append((at, ident, amount, mark if other else None))
                else:
                    legs.put(at, ident, amount, mark if other else None)
            yield pd.DataFrame(rows, columns=["asset", "out_id", "in_id", "pair_id"])
        yield pd.DataFrame(pairs(None), columns=["asset", "out_id", "in_id", "pair_id"])

    return run


def nearest(legs: DataFrame, *keys: str, before: float = float("inf"), after: float = float("inf"), other: bool = False) -> DataFrame:
    """(asset, out_id, in_id, pair_id): within each asset and key, each leg out, in order of time, takes the unused leg in of least score (amounts and
    times apart) from `before` seconds before to `after` seconds after it, if its amount fits; with `other` of another mark, or of none.

    Legs: asset, id, at (seconds), amount, mark, out, and the keys, of which null is one. They are dealt by asset and key, sorted by Spark and walked once: what
    moves grows with the legs, not with the candidates. A task holds the legs in of a window, without a window those of a key. Rows
    with a null asset, id, time or amount, and amounts that are no number, have no pair.
    """
    by = [*dict.fromkeys(["asset", *keys])]
    x = legs.where("asset is not null and id is not null and at is not null and amount is not null and not isnan(amount) and out is not null")
    x = x.select(*dict.fromkeys([*by, "id", "at", "amount", "mark", "out"]))
    x = x.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, "at", "id", "out", "amount", "mark")
    return x.mapInPandas(_walk_nearest(by, before, after, other), "asset string, out_id string, in_id string, pair_id string")


def _transfers(ledger: DataFrame) -> DataFrame:
    """Unpaired transfers as legs; `group` is the on-chain id or else the trade group."""
    group = F.coalesce(F.nullif("on_chain_tx_id", F.lit("")), F.nullif("trade_group_id", F.lit("")))
    t = ledger.where("transaction_type = 'TRANSFER' and transfer_pair_id is null and amount > 0 and transfer_direction in ('OUT', 'IN')")
    return t.select("asset", "id", (F.unix_micros("timestamp") / 1e6).alias("at"), F.col("amount").cast("double").alias("amount"), F.col("source").alias("mark"), (F.col("transfer_direction") == "OUT").alias("out"), group.alias("group"))


def transfer_pairs(ledger: DataFrame, window_hours: float = 48) -> DataFrame:
    """Each leg out, in order of time, takes the unused leg in of best score at another venue. Candidates never cross assets, so assets are apart."""
    size = window_hours * HOURS
    return nearest(_transfers(ledger), before=size, after=size, other=True)


def on_chain_pairs(ledger: DataFrame) -> DataFrame:
    """Pairs of one asset under one on-chain id, or else trade group: of any venues and at any distance in time."""
    return nearest(_transfers(ledger).where("group is not null"), "group")


def earn_pairs(ledger: DataFrame, days: float = EARN_DAYS) -> DataFrame:
    """Deposits to an earn account with the later withdrawals from it at the same venue."""
    deposit, back = F.col("out") & F.lower("id").rlike(EARN_OUT), ~F.col("out") & F.lower("id").contains(EARN_IN)
    return nearest(_transfers(ledger).where(deposit | back), "mark", before=0, after=days * 24 * HOURS)


def internal_transfers(ledger: DataFrame, window_hours: float = 48) -> DataFrame:
    """All pairs of transfers: by on-chain id or trade group, then earn round trips, then across venues; a leg that is used is used up."""
    left, found = ledger, None
    for step in (on_chain_pairs, earn_pairs, lambda x: transfer_pairs(x, window_hours)):
        pairs = cut(step(left))
        found = pairs if found is None else found.unionByName(pairs)
        used = pairs.select(F.explode(F.array("out_id", "in_id")).alias("_used"))
        left = left.join(used, F.col("id") == F.col("_used"), "left_anti")
    return found


def annotate(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.explode(F.array("out_id", "in_id")).alias("_id"), F.col("pair_id").alias("_p"))
    return ledger.join(ids, F.col("id") == F.col("_id"), "left").withColumn("transfer_pair_id", F.coalesce("transfer_pair_id", "_p")).drop("_id", "_p")


def staking_echoes(ledger: DataFrame, hours: float = 48, tolerance: float = 0.02) -> DataFrame:
    """Transfers out that only echo a staking reward of the same venue, asset and amount in the hours before."""
    size = hours * HOURS
    x = ledger.withColumn("at", F.unix_micros("timestamp") / 1e6)
    out = x.where("transaction_type = 'TRANSFER' and transfer_direction = 'OUT'").select("id", "asset", "source", "at", "amount", F.floor(F.col("at") / size).alias("bucket"))
    s = x.where("transaction_type = 'STAKING'").select("asset", "source", F.col("at").alias("s_at"), F.col("amount").alias("s_amount"), F.explode(F.array(F.floor(F.col("at") / size), F.floor(F.col("at") / size) + 1)).alias("bucket"))
    near = (F.col("at") >= F.col("s_at")) & (F.col("at") - F.col("s_at") <= size) & (F.abs(F.col("amount") - F.col("s_amount")) <= F.greatest("amount", "s_amount") * tolerance)
    return out.join(s, ["asset", "source", "bucket"]).where(near).select("id").distinct()


def mistyped_transfers(ledger: DataFrame, minutes: float = 5, tolerance: float = 1e-6) -> DataFrame:
    """Pairs of a sale at one venue and a purchase of the same amount at another within minutes: (asset, out_id, in_id, pair_id).

    Rows with a mark of a market trade (counter asset, order type, result) and derivatives are no candidates.
    """
    x = ledger.where("counter_asset is null and venue_order_type is null and realized_pnl is null and source is not null and coalesce(instrument_kind, '') <> 'perp'")
    x = x.withColumns({"at": F.unix_micros("timestamp") / 1e6, "mark": F.col("source")})
    return earliest(x.where("transaction_type = 'SELL'"), x.where("transaction_type = 'BUY'"), minutes * 60, minutes * 60, tolerance, other=True)


def as_transfers(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """Types the legs of pairs as a transfer out and in."""
    ids = pairs.select(F.explode(F.array(F.struct(F.col("out_id").alias("i"), F.lit("OUT").alias("w"), "pair_id"), F.struct(F.col("in_id").alias("i"), F.lit("IN").alias("w"), "pair_id"))).alias("x")).select("x.i", "x.w", F.col("x.pair_id").alias("_p"))
    hit = F.col("i").isNotNull()
    x = ledger.join(ids, F.col("id") == F.col("i"), "left")
    return x.withColumns({"transaction_type": F.when(hit, "TRANSFER").otherwise(F.col("transaction_type")), "transfer_direction": F.coalesce("w", "transfer_direction"), "transfer_pair_id": F.coalesce("_p", "transfer_pair_id")}).select(*ledger.columns)
