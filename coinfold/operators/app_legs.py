"""Legs of an app's swaps that its export left out, made up from the legs it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..functions.spread import carried, look_up

# The app, its kinds of swaps as they stand in row ids, and how long after a swap a purchase may tell a price.
APP = "cryptocom"
SWAP_KINDS = ("crypto_exchange", "crypto_viban_exchange", "trading", "trade")
LATER_SECONDS = 600


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_swap(kinds: tuple[str, ...] = SWAP_KINDS) -> Column:
    return _yes((F.col("source") == APP) & F.col("id").rlike("-(" + "|".join(kinds) + ")-"))


def _order() -> Column:
    return F.struct(F.coalesce("seq", F.lit(0)), "id")


def counter_amounts(ledger: DataFrame) -> DataFrame:
    """The ledger with amounts of counter legs where swaps lack them: from the leg that is there, at the same moment; else the swap's value
    at the price of the last purchase of the counter asset up to then, or of the first one within ten minutes after."""
    x = ledger.withColumn("_swap", is_swap())
    peer = x.where("_swap and amount > 0").groupBy(F.col("timestamp").alias("_at"), F.col("asset").alias("_of")).agg(F.min_by("amount", _order()).alias("_peer"))
    asks = x.where("_swap and counter_asset is not null and coalesce(counter_amount, 0) = 0").select("id", "timestamp", F.col("counter_asset").alias("of"), F.coalesce("seq", F.lit(0)).alias("n"), F.lit(1).alias("ask"), F.lit(None).cast("double").alias("unit"))
    price = F.when((F.col("fiat_value_at_trigger") > 0) & (F.col("amount") > 0), F.col("fiat_value_at_trigger") / F.col("amount"))
    told = ledger.where("transaction_type = 'BUY'").select("id", "timestamp", F.col("asset").alias("of"), F.coalesce("seq", F.lit(0)).alias("n"), F.lit(0).alias("ask"), price.alias("unit")).where("unit is not null")
    both = asks.unionByName(told)
    both = carried(both, "of", [F.col("timestamp"), F.col("ask"), F.col("n"), F.col("id")], F.col("unit"), "earlier")
    both = carried(both, "of", [F.col("timestamp").desc(), F.col("ask").desc(), F.col("n").desc(), F.col("id").desc()], F.when(F.col("unit").isNotNull(), F.struct("timestamp", "unit")), "later")
    soon = F.unix_micros("later.timestamp") - F.unix_micros("timestamp") <= LATER_SECONDS * 1_000_000
    units = both.where("ask = 1").select(F.col("id").alias("_id"), "timestamp", "of", F.coalesce("earlier", F.when(soon, F.col("later.unit"))).alias("_unit"))
    # Peers are joined with the few columns of a question, and only rows that ask are dealt whole.
    units = cut(units.join(peer, (F.col("timestamp") == F.col("_at")) & (F.col("of") == F.col("_of")), "left").select("_id", "_unit", "_peer"))
    # A row is no peer of itself: that takes a counter asset that is its own.
    found = F.coalesce(F.when(F.col("asset") != F.col("counter_asset"), F.col("_peer")), F.when(F.col("fiat_value_at_trigger") > 0, F.try_divide("fiat_value_at_trigger", "_unit")))
    lacks = F.col("_swap") & F.col("counter_asset").isNotNull() & (F.coalesce("counter_amount", F.lit(0.0)) == 0)
    asked = x.where(lacks).join(units, F.col("id") == F.col("_id"), "left").withColumn("counter_amount", F.when(found > 0, F.round(found, 8)).otherwise(F.col("counter_amount")))
    return x.where(~lacks).select(*ledger.columns).unionByName(asked.select(*ledger.columns))


def missing_legs(ledger: DataFrame) -> DataFrame:
    """The ledger with both legs of each of the app's swaps.

    A purchase that names a counter asset of which nothing was sold at that moment gets the sale, a sale the purchase, with the counter leg's amount and the
    value of the leg that is there; fiat and stablecoins have no leg. Of several legs that ask for the same one the first does. Legs that led
    to one, and it, share a trade group where they have none. A second run adds nothing.
    """
    x = cut(counter_amounts(ledger).withColumn("_swap", is_swap()))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    extras = []
    for have, lack in (("BUY", "SELL"), ("SELL", "BUY")):
        there = x.where((F.col("source") == APP) & (F.col("transaction_type") == lack)).select("timestamp", F.col("asset").alias("counter_asset")).distinct()
        legs = x.where(F.col("_swap") & (F.col("transaction_type") == have) & (F.col("counter_asset") != "") & ~F.col("counter_asset").isin(*S.FIATS) & ~S.is_stable(F.col("counter_asset")) & (F.col("counter_amount") > 0))
        # The first leg of an asset at a moment speaks for it.
        first = legs.groupBy("timestamp", "asset").agg(F.min_by(F.struct("counter_asset", "counter_amount", "amount", "fiat_value_at_trigger", "fiat_currency", F.coalesce("seq", F.lit(0)).alias("n"), "id"), _order()).alias("r"))
        alone = first.select("timestamp", "asset", "r.*").join(there, ["timestamp", "counter_asset"], "left_anti")
        one = alone.groupBy("timestamp", "counter_asset").agg(F.min_by(F.struct("asset", "counter_amount", "amount", "fiat_value_at_trigger", "fiat_currency"), F.struct("n", "id")).alias("r"))
        extras.append(one.select(F.concat(F.lit("cdc-"), stamp, F.lit(f"-crypto_exchange-{lack.lower()}-"), F.col("counter_asset")).alias("id"), "timestamp", F.col("counter_asset").alias("asset"), F.lit(lack).alias("transaction_type"), F.col("r.counter_amount").alias("amount"),
                                 F.col("r.fiat_value_at_trigger").alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.col("r.fiat_currency").alias("fiat_currency"), F.col("r.asset").alias("counter_asset"), F.col("r.amount").alias("counter_amount"), F.lit(APP).alias("source"),
                                 F.concat(F.lit("cdc-xchg-"), stamp).alias("trade_group_id")))
    made = cut(extras[0].unionByName(extras[1]))
    led = made.select(F.col("timestamp").alias("_at"), F.col("counter_asset").alias("_of"), F.col("trade_group_id").alias("_group")).distinct()
    # Rows that have a group stay where they lie.
    lone = F.coalesce("trade_group_id", F.lit("")) == ""
    found = look_up(x.where(lone), led, (F.col("timestamp") == F.col("_at")) & (F.col("asset") == F.col("_of"))).withColumn("trade_group_id", F.col("_group"))
    x = x.where(~lone).select(*ledger.columns).unionByName(found.select(*ledger.columns))
    return x.unionByName(made.select(*[F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in ledger.dtypes]))
