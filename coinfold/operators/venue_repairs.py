"""Repairs of one venue's rows: proceeds booked as fees, movements booked as sales, legs of one purchase, quotes in stablecoins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .pairing import assigned

VENUE = "kraken"
MICRO_FEE = 0.0025
DAYS = 86400.0


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _value() -> Column:
    return F.coalesce("fiat_value_at_trigger", F.lit(0.0))


def _quote(asset: Column) -> Column:
    return S.is_stable(asset) | F.upper(asset).isin(*S.FIATS)


def _set(df: DataFrame, hit: Column, **new: Column) -> DataFrame:
    """Sets columns in the rows of `hit`; all values are taken from before."""
    hit = F.coalesce(hit, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def proceeds_as_fees(ledger: DataFrame, venue: str = VENUE, ratio: float = 1000.0) -> DataFrame:
    """Fee rows without value whose fee is at least 1 and `ratio` times the amount are sales for that fee."""
    fee = F.coalesce("fee_fiat", F.lit(0.0))
    hit = (F.col("source") == venue) & (F.col("transaction_type") == "FEE") & ~_quote(F.col("asset")) & (F.coalesce("trade_group_id", F.lit("")) != "") & (_value() <= 0) & (F.col("amount") > 0) & (fee >= 1) & (fee >= F.col("amount") * ratio)
    money, quote = F.round(fee, 2), F.coalesce("fiat_currency", F.lit("GBP"))
    return _set(ledger, hit, transaction_type=F.lit("SELL"), fiat_value_at_trigger=money, fee_fiat=F.lit(0.0), fiat_currency=quote, counter_asset=quote, counter_amount=money)


def _unfunded(limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = 0.0
        for b in batches:
            fees = []
            for r in b.itertuples(index=False):
                if r.buy:
                    held += r.amount
                elif r.free and r.amount <= limit and r.amount > held + 1e-12:
                    fees.append(r.id)
                else:
                    held = max(0.0, held - r.amount)
            yield pd.DataFrame({"fee_id": pd.Series(fees, dtype=object)})

    return run


def micro_fees(ledger: DataFrame, venue: str = VENUE, asset: str = "BTC", limit: float = MICRO_FEE) -> DataFrame:
    """Tiny sales without value that exceed what was bought before (less what was sold, never below 0) are fees.

    Each decision changes the balance that the next one sees, so the venue's trades of the one asset are sorted
    and streamed through one running number; no group is held in memory.
    """
    t = F.col("transaction_type")
    x = ledger.where((F.col("source") == venue) & (F.col("asset") == asset) & t.isin("BUY", "SELL") & (F.col("amount") > 0))
    x = x.select("id", "timestamp", "amount", (t == "BUY").alias("buy"), (_value() <= 0).alias("free"))
    fees = x.repartition(1).sortWithinPartitions("timestamp", "id").mapInPandas(_unfunded(limit), "fee_id string")
    y = ledger.join(fees, F.col("id") == F.col("fee_id"), "left")
    return _set(y, F.col("fee_id").isNotNull(), transaction_type=F.lit("FEE"), fee_fiat=F.round(_value(), 2), fiat_value_at_trigger=F.lit(0.0)).select(*ledger.columns)


def movements(ledger: DataFrame, venue: str = VENUE) -> DataFrame:
    """Sales without value are transfers out, except of stablecoins."""
    hit = (F.col("source") == venue) & (F.col("transaction_type") == "SELL") & (_value() <= 0) & ~S.is_stable(F.col("asset"))
    return _set(ledger, hit, transaction_type=F.lit("TRANSFER"), transfer_direction=F.lit("OUT"))


def spend_receive(ledger: DataFrame, venue: str = VENUE) -> DataFrame:
    """In a trade group with sales and transfers in, the transfers become purchases that share the sales' value by quantity.

    The sales name the first transfer as their counter leg. Groups whose sales have no value stay as they are.
    """
    w = S.group_window("trade_group_id")
    t = F.col("transaction_type")
    mine = (F.col("source") == venue) & (F.coalesce("trade_group_id", F.lit("")) != "") & ~_quote(F.col("asset"))
    spend = F.coalesce(mine & (t == "SELL"), F.lit(False))
    receive = F.coalesce(mine & (t == "TRANSFER") & (F.col("transfer_direction") == "IN"), F.lit(False))
    q = S.units(F.col("amount"))
    x = ledger.withColumns({"_s": spend, "_r": receive}).withColumns({
        "_total": F.sum(F.when(F.col("_s"), S.cents(_value()))).over(w), "_whole": F.sum(F.when(F.col("_r"), q)).over(w), "_first": F.min(F.when(F.col("_r"), F.struct("timestamp", "id", "asset", "amount"))).over(w),
        "_ccy": F.coalesce(F.min(F.when(F.col("_s") & F.col("fiat_currency").isNotNull(), F.struct("timestamp", "id", "fiat_currency"))).over(w)["fiat_currency"], F.lit("GBP")),
    })
    paired = (F.col("_total") > 0) & (F.col("_whole") > 0)
    sell, buy = paired & F.col("_s"), paired & F.col("_r")
    x = x.withColumns({"_sell": sell, "_buy": buy, "_part": F.when(buy, S.money(S.share(F.col("_total"), q, F.col("_whole"))))})
    x = _set(x, F.col("_sell"), counter_asset=F.col("_first.asset"), counter_amount=F.col("_first.amount"), fiat_currency=F.col("_ccy"))
    return _set(x, F.col("_buy"), transaction_type=F.lit("BUY"), transfer_direction=_none(), fiat_value_at_trigger=F.col("_part"), fiat_currency=F.col("_ccy")).select(*ledger.columns)


def receive_sale_pairs(ledger: DataFrame, venue: str = VENUE, days: float = 7, tolerance: float = 0.005) -> DataFrame:
    """(asset, out_id, in_id, pair_id): transfers in (out_id), in order of time, each with the nearest unused later sale of about its amount."""
    size = days * DAYS
    x = ledger.where((F.col("source") == venue) & ~S.is_stable(F.col("asset"))).withColumn("at", F.unix_micros("timestamp") / 1e6)
    into = x.where("transaction_type = 'TRANSFER' and transfer_direction = 'IN'").select("asset", F.col("id").alias("out_id"), F.col("at").alias("out_at"), F.col("amount").alias("a1"), F.explode(F.array(F.floor(F.col("at") / size), F.floor(F.col("at") / size) + 1)).alias("bucket"))
    sale = x.where("transaction_type = 'SELL'").select("asset", F.col("id").alias("in_id"), F.col("at").alias("in_at"), F.col("amount").alias("a2"), F.floor(F.col("at") / size).alias("bucket"))
    near = (F.col("in_at") >= F.col("out_at")) & (F.col("in_at") - F.col("out_at") <= size) & (F.abs(F.col("a1") - F.col("a2")) <= F.greatest("a1", "a2", F.lit(1e-9)) * tolerance)
    c = into.join(sale, ["asset", "bucket"]).where(near).select("asset", "out_id", "in_id", "out_at", "in_at", (F.col("in_at") - F.col("out_at")).alias("score"))
    return assigned(c, "asset", seconds=size)


def receive_before_sale(ledger: DataFrame, **kw) -> DataFrame:
    """The transfers in of `receive_sale_pairs` become purchases at their sale's value, by the ratio of amounts."""
    p = receive_sale_pairs(ledger, **kw).select(F.col("out_id").alias("_id"), "in_id")
    sale = ledger.select(F.col("id").alias("in_id"), _value().alias("_v"), F.col("amount").alias("_a"), F.col("fiat_currency").alias("_c"))
    x = ledger.join(p.join(sale, "in_id"), F.col("id") == F.col("_id"), "left")
    ratio = F.when(F.col("_a") > 0, F.col("amount") / F.col("_a")).otherwise(1.0)
    money = F.round(F.greatest(F.col("_v") * ratio, F.lit(0.0)), 2)
    return _set(x, F.col("_id").isNotNull(), transaction_type=F.lit("BUY"), transfer_direction=_none(), fiat_value_at_trigger=money, fiat_currency=F.coalesce("_c", "fiat_currency", F.lit("GBP"))).select(*ledger.columns)


def venue_repairs(ledger: DataFrame, venue: str = VENUE) -> DataFrame:
    """All repairs of the venue's rows in their fixed order."""
    x = movements(micro_fees(proceeds_as_fees(ledger, venue), venue), venue)
    return receive_before_sale(spend_receive(x, venue), venue=venue)


def stable_quotes(ledger: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Trades name the stablecoin leg of the other side whose amount is about their value (same second and venue); that leg goes.

    Several trades may name one leg; of several legs the first counts. Candidates meet by buckets of the value's logarithm.
    """
    side = F.col("transaction_type").isin("BUY", "SELL")
    x = ledger.where(side).select("id", "timestamp", F.date_trunc("second", "timestamp").alias("at"), F.coalesce("source", F.lit("")).alias("venue"), "asset", (F.col("transaction_type") == "BUY").alias("buy"), "amount", _value().alias("v"), S.is_stable(F.col("asset")).alias("stable"))
    bucket = lambda c: F.floor(F.log(F.greatest(c, F.lit(1e-9))) / 0.0203 * (0.02 / tolerance)).cast("bigint")
    trade = x.where("not stable").select("id", "at", "venue", "buy", "v", bucket(F.col("v")).alias("b"))
    leg = x.where("stable").select("at", "venue", (~F.col("buy")).alias("buy"), F.col("amount").alias("q"), F.struct("timestamp", F.col("id").alias("leg"), F.col("asset").alias("coin")).alias("s"), F.explode(F.array(*[bucket(F.col("amount")) + i for i in (-1, 0, 1)])).alias("b"))
    near = F.abs(F.col("q") - F.col("v")) <= F.greatest("q", "v", F.lit(1e-9)) * tolerance
    m = trade.join(leg, ["at", "venue", "buy", "b"]).where(near).groupBy("id").agg(F.min("s").alias("s")).select(F.col("id").alias("_id"), F.col("s.leg").alias("_leg"), F.col("s.coin").alias("_coin"))
    y = ledger.join(m.select("_id", "_coin"), F.col("id") == F.col("_id"), "left").join(m.select(F.col("_leg").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left_anti")
    return _set(y, F.col("_id").isNotNull(), counter_asset=F.col("_coin"), fiat_currency=F.col("_coin")).select(*ledger.columns)
