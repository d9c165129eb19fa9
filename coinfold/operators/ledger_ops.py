"""Filters, deduplication, aggregations and interval operators on the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..functions.spread import look_up


def with_rate(ledger: DataFrame, to_ccy: str = "GBP", rates: DataFrame | None = None) -> DataFrame:
    """The ledger with `from_ccy`, `fx_day` and `fx_rate` to the reporting currency: the day's rate from `rates` (day, from_ccy, rate), else the fallback.

    Days are the UK's for GBP and UTC's for others. A currency's rate to itself is 1. The rates are few and counted, so the ledger isn't dealt by
    day for them; Spark's own estimate takes them for as large as the table they come from.
    """
    day = S.uk_day(F.col("timestamp")) if to_ccy == "GBP" else F.to_date("timestamp")
    x = ledger.withColumns({"from_ccy": S.resolve_currency(F.col("fiat_currency"), F.col("source")), "fx_day": day})
    fixed = S.fixed_rate(F.col("from_ccy"), to_ccy)
    if rates is None:
        return x.withColumn("fx_rate", fixed)
    r = cut(rates.where(F.col("from_ccy") != to_ccy).groupBy(F.col("day").alias("fx_day"), "from_ccy").agg(F.max("rate").cast("decimal(12,8)").alias("_day_rate")))
    return look_up(x, r, ["fx_day", "from_ccy"]).withColumn("fx_rate", F.coalesce("_day_rate", fixed)).drop("_day_rate")


def reporting_value(ledger: DataFrame, to_ccy: str = "GBP", rates: DataFrame | None = None) -> DataFrame:
    """Value in the reporting currency, to the cent; 0 stays 0, null counts as 0."""
    return with_rate(ledger, to_ccy, rates).withColumn("value", S.money(S.converted(F.col("fiat_value_at_trigger"), F.col("fx_rate"))))


def is_dust(min_amount: float = 1e-6, min_fiat: float = 0.5) -> Column:
    """Rows too small to matter; liquidity legs never are."""
    v = F.coalesce("fiat_value_at_trigger", F.lit(0.0))
    lp = F.coalesce(F.col("event_subtype").isin("lp_add", "lp_remove"), F.lit(False))
    return ~lp & ((F.col("amount") < min_amount) | ((v > 0) & (v < min_fiat)) | ((F.col("asset") == "SOL") & (F.col("amount") < 1e-4)))


def is_spam(asset: Column) -> Column:
    """Labels that advertise: addresses of sites, over-long names, calls to claim."""
    core = F.upper(asset).isin("BTC", "ETH", "SOL", "ADA", *S.STABLES)
    url = F.lower(asset).rlike(r"(https?:|www\.|t\.me|\.(com|io|net|org|xyz|app|fi|gg|top)\b)")
    return ~core & (url | (F.length(asset) > 32) | F.upper(asset).rlike("CLAIM|REWARD|AIRDROP|VISIT"))


def dedup(ledger: DataFrame) -> DataFrame:
    """Three stages: by id, by content, by on-chain leg.

    In the first two, the row with an on-chain id wins, then the higher value, the earlier time, the earlier position; in the third
    the earliest position. Rows without an on-chain id pass the third. A null in a key is a value of its own.
    """
    has = F.col("on_chain_tx_id").isNotNull().cast("int").desc()
    best = [has, F.coalesce("fiat_value_at_trigger", F.lit(0.0)).desc(), "timestamp", "seq", "id"]

    def first(df: DataFrame, keys: list, order: list) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

    # The rounded amount is a column of its own, so both branches below need the same columns of the rows dealt by content, which are then dealt once for both.
    content = ["timestamp", "asset", "transaction_type", "_amount", F.round("fiat_value_at_trigger", 2), "source", "transfer_direction", "trade_group_id", "instrument"]
    x = first(first(ledger.withColumn("_amount", F.round("amount", 8)), ["id"], best), content, best)
    chained = first(x.where("on_chain_tx_id is not null"), ["on_chain_tx_id", "asset", "transaction_type", "transfer_direction", "_amount", "source"], ["seq", "id"])
    return chained.unionByName(x.where("on_chain_tx_id is null")).drop("_amount")


def new_rows(incoming: DataFrame, present: DataFrame) -> DataFrame:
    """Incoming rows of which neither the id nor the content is present."""
    key = ["timestamp", "asset", "transaction_type", "amount", "source"]
    return incoming.join(present.select("id"), "id", "left_anti").join(present.select(*key), key, "left_anti")


def income_rows(ledger: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Income row by row with its UK day, tax year and value in GBP cents; rows without an amount left out."""
    x = with_rate(ledger.where(F.col("transaction_type").isin(*S.INCOME) & (F.col("amount") > 0)), "GBP", rates)
    return x.select("id", "asset", "source", "transaction_type", F.col("fx_day").alias("day"), S.uk_tax_year(F.col("fx_day")).alias("tax_year"), "amount", S.converted(F.col("fiat_value_at_trigger"), F.col("fx_rate")).alias("income_c"))


def income_by_year(ledger: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Income by UK tax year and kind in GBP."""
    g = income_rows(ledger, rates).groupBy("tax_year", "transaction_type").agg(F.count("*").alias("n_rows"), F.sum("income_c").alias("c"))
    return g.select("tax_year", "transaction_type", "n_rows", S.money(F.col("c")).alias("income"))


def income_by_asset(ledger: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Income by asset in GBP, rewards and airdrops apart; null where an asset has none of a kind."""
    kind = lambda t: F.sum(F.when(F.col("transaction_type") == t, F.col("income_c")))
    g = income_rows(ledger, rates).groupBy("asset").agg(F.count("*").alias("n_rows"), F.sum(S.units(F.col("amount"))).alias("q"), kind("STAKING").alias("s"), kind("AIRDROP").alias("a"))
    return g.select("asset", "n_rows", S.quantity(F.col("q")).alias("quantity"), S.money(F.col("s")).alias("staking"), S.money(F.col("a")).alias("airdrops"))


def perp_legs(ledger: DataFrame, to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """Rows of derivatives with result, fee and notional in cents of the reporting currency; a null result is no close."""
    x = with_rate(ledger.where(S.is_perp(F.col("instrument_kind"), F.col("source"))), to_ccy, rates)
    c = lambda n: S.converted(F.col(n), F.col("fx_rate"))
    return x.withColumns({"pnl_c": F.when(F.col("realized_pnl").isNotNull(), c("realized_pnl")), "fee_c": c("fee_fiat"), "notional_c": c("fiat_value_at_trigger")})


def perps_summary(ledger: DataFrame, to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """Fills, results, fees and notional of derivatives by source."""
    g = perp_legs(ledger, to_ccy, rates).groupBy("source").agg(
        F.count("*").alias("fills"), F.sum("pnl_c").alias("pnl"), F.count_if(F.col("realized_pnl") > 0).alias("wins"), F.count_if(F.col("realized_pnl") < 0).alias("losses"), F.sum("fee_c").alias("fee"), F.sum("notional_c").alias("notional")
    )
    return g.select("source", "fills", "wins", "losses", *[S.money(F.col(c)).alias(c) for c in ("pnl", "fee", "notional")])


def perp_schedule(ledger: DataFrame, to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """Result less fee of derivatives' closes by year, gains and losses apart."""
    net = F.col("pnl_c") - F.col("fee_c")
    x = perp_legs(ledger, to_ccy, rates).where("realized_pnl is not null")
    g = x.groupBy(F.year("timestamp").alias("year")).agg(F.count("*").alias("n"), F.sum(F.greatest(net, F.lit(0))).alias("g"), F.sum(F.greatest(-net, F.lit(0))).alias("l"))
    return g.select("year", "n", S.money(F.col("g")).alias("gains"), S.money(F.col("l")).alias("losses"))


def net_flows(ledger: DataFrame, to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """Net quantity and value in and out for each trade group and asset."""
    t = F.col("transaction_type")
    inward = t.isin(*S.ACQUISITIONS) | ((t == "TRANSFER") & (F.col("transfer_direction") == "IN"))
    v = S.converted(F.col("fiat_value_at_trigger"), F.col("fx_rate"))
    g = with_rate(ledger.where("trade_group_id is not null"), to_ccy, rates).groupBy("trade_group_id", "asset").agg(
        F.sum(F.when(inward, S.units(F.col("amount"))).otherwise(-S.units(F.col("amount")))).alias("q"), F.sum(F.when(inward, v).otherwise(0)).alias("vin"), F.sum(F.when(inward, 0).otherwise(v)).alias("vout"), F.count("*").alias("n_legs")
    )
    return g.select("trade_group_id", "asset", "n_legs", S.quantity(F.col("q")).alias("net_quantity"), S.money(F.col("vin")).alias("value_in"), S.money(F.col("vout")).alias("value_out"))


def swap_basis(ledger: DataFrame) -> DataFrame:
    """Groups with value on one side only: the other side's rows take it, several by their share of the quantity, in whole cents."""
    w = S.group_window("trade_group_id")
    v, u, t = S.cents(F.coalesce("fiat_value_at_trigger", F.lit(0.0))), S.units(F.col("amount")), F.col("transaction_type")
    total = lambda kind, c: F.sum(F.when(t == kind, c).otherwise(0)).over(w).cast("decimal(38,0)")
    x = ledger.withColumns({"_s": total("SELL", v), "_b": total("BUY", v), "_q": total("BUY", u), "_n": F.count_if(t == "SELL").over(w)})
    grouped = F.col("trade_group_id").isNotNull()
    new = F.when(grouped & (t == "BUY") & (F.col("_b") == 0) & (F.col("_s") > 0) & (F.col("_q") > 0), S.money(S.share(F.col("_s"), u, F.col("_q")))).when(grouped & (t == "SELL") & (F.col("_s") == 0) & (F.col("_b") > 0) & (F.col("_n") == 1), S.money(F.col("_b"))).otherwise(F.col("fiat_value_at_trigger"))
    return x.withColumn("fiat_value_at_trigger", new).drop("_s", "_b", "_q", "_n")


def coverage_gaps(intervals: DataFrame, min_gap_days: int = 7) -> DataFrame:
    """Gaps of at least `min_gap_days` between islands of intervals (key, start_day, end_day) that are at most a day apart."""
    w = Window.partitionBy("key").orderBy("start_day", "end_day")
    x = intervals.withColumn("reach", F.max("end_day").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.datediff("start_day", "reach")
    return x.where(gap >= min_gap_days).select("key", F.col("reach").alias("gap_start"), F.col("start_day").alias("gap_end"), gap.alias("gap_days"))


def import_ranges(ledger: DataFrame) -> DataFrame:
    return ledger.where("import_id is not null").groupBy("import_id").agg(F.min(F.to_date("timestamp")).alias("start_day"), F.max(F.to_date("timestamp")).alias("end_day"), F.count("*").alias("n_rows"), F.mode("source", True).alias("source"))


def import_overlaps(ledger: DataFrame) -> DataFrame:
    """Pairs of imports of one source whose days overlap, with the number of legs they share by content."""
    r = import_ranges(ledger)
    a, b = (r.select("source", F.col("import_id").alias(f"{s}_id"), F.col("start_day").alias(f"{s}_start"), F.col("end_day").alias(f"{s}_end")) for s in "ab")
    pairs = a.join(b, "source").where("a_id < b_id and a_start <= b_end and b_start <= a_end")
    key = ["day", "asset", "transaction_type", "amount"]
    legs = ledger.select("import_id", F.to_date("timestamp").alias("day"), "asset", "transaction_type", "amount").distinct()
    x, y = legs.withColumnRenamed("import_id", "a_id"), legs.withColumnRenamed("import_id", "b_id")
    shared = x.join(y, key).where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    days = F.datediff(F.least("a_end", "b_end"), F.greatest("a_start", "b_start")) + 1
    return pairs.join(shared, ["a_id", "b_id"], "left").select("source", "a_id", "b_id", days.alias("overlap_days"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def orphan_inflows(ledger: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Transfers in without pair, value or override: their basis is missing."""
    x = ledger.where((F.col("transaction_type") == "TRANSFER") & (F.col("transfer_direction") == "IN") & F.col("transfer_pair_id").isNull() & (F.col("amount") >= 1e-6) & ~S.is_stable(F.col("asset")) & (F.coalesce("fiat_value_at_trigger", F.lit(0.0)) <= 0.5))
    return x if overrides is None else x.join(overrides.select(F.col("anchor_id").alias("id")), "id", "left_anti")


def with_overrides(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds a purchase for each override (anchor_id, acquired_at, total_fiat) and pairs its anchor, which so becomes neutral."""
    o = overrides.select(F.col("anchor_id").alias("_a"), "acquired_at", "total_fiat")
    x = ledger.join(o, F.col("id") == F.col("_a"), "left")
    pair = F.concat(F.lit("manual-basis-"), "_a")
    anchors = x.withColumn("transfer_pair_id", F.coalesce(F.when(F.col("_a").isNotNull(), pair), F.col("transfer_pair_id"))).select(*ledger.columns)
    buys = x.where("_a is not null").withColumns({"id": F.concat(F.lit("manual-buy-"), "_a"), "timestamp": F.col("acquired_at"), "transaction_type": F.lit("BUY"), "fiat_value_at_trigger": F.col("total_fiat"), "fee_fiat": F.lit(0.0), "transfer_direction": F.lit(None).cast("string"), "transfer_pair_id": F.lit(None).cast("string")})
    return anchors.unionByName(buys.select(*ledger.columns))


def last_price(ledger: DataFrame) -> DataFrame:
    """For each disposal the unit price of the latest earlier purchase of the asset (as-of join by one sort)."""
    w = Window.partitionBy("asset").orderBy("timestamp", F.col("transaction_type") != "BUY", "id").rowsBetween(Window.unboundedPreceding, -1)
    p = F.when((F.col("transaction_type") == "BUY") & (F.col("amount") > 0), F.struct(F.col("timestamp").alias("at"), (F.col("fiat_value_at_trigger") / F.col("amount")).alias("price")))
    x = ledger.withColumn("_p", F.last(p, True).over(w)).where("transaction_type = 'SELL'")
    return x.select("id", "asset", "timestamp", F.col("_p.at").alias("price_at"), F.col("_p.price").alias("last_price"))


def search(ledger: DataFrame, text: str | None = None, source: str | None = None, kinds: list[str] | None = None, hide_dust: bool = True) -> DataFrame:
    x = ledger
    if source:
        x = x.where(F.col("source") == source)
    if kinds:
        x = x.where(F.col("transaction_type").isin(*kinds))
    if hide_dust:
        x = x.where(~is_dust())
    if text:
        fields = ("id", "asset", "transaction_type", "source", "trade_group_id", "on_chain_tx_id", "counter_asset", "counterparty_address", "instrument", "token_mint")
        x = x.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))
    return x


def leg_groups(ledger: DataFrame, to_ccy: str = "USD", rates: DataFrame | None = None) -> DataFrame:
    """Groups of two legs and more under one trade group or transaction."""
    ledger = with_rate(ledger, to_ccy, rates)
    key = F.coalesce("trade_group_id", "on_chain_tx_id")
    order = F.create_map(*[F.lit(x) for p in (("SELL", 1), ("BUY", 2), ("STAKING", 3), ("AIRDROP", 4), ("TRANSFER", 5), ("FEE", 6)) for x in p])
    g = ledger.where(key.isNotNull()).groupBy(key.alias("group_key")).agg(
        F.count("*").alias("n_legs"), F.countDistinct("asset").alias("n_assets"), F.min("timestamp").alias("first_at"), F.sum(S.converted(F.col("fiat_value_at_trigger"), F.col("fx_rate"))).alias("c"), F.min_by("transaction_type", F.element_at(order, F.col("transaction_type"))).alias("primary_type")
    )
    return g.where("n_legs >= 2").select("group_key", "n_legs", "n_assets", "first_at", "primary_type", S.money(F.col("c")).alias("value"))


def dex_price(pairs: DataFrame) -> DataFrame:
    """Price of an asset from pairs (asset, price, liquidity): thin pairs go, then those far from the upper median, then the mean by liquidity."""
    ok = pairs.where("price > 0 and liquidity >= 1000")
    weight = F.col("liquidity").cast("decimal(18,2)")  # exact sums, in any order
    w = Window.partitionBy("asset")
    rank, n = F.row_number().over(w.orderBy("price", "liquidity")), F.count("*").over(w)
    x = ok.withColumns({"_r": rank, "_n": n})
    mid = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("price"))).over(w)
    x = x.withColumn("_m", mid).where((F.col("price") >= F.col("_m") / 5) & (F.col("price") <= F.col("_m") * 5))
    return x.groupBy("asset").agg((F.sum(F.col("price").cast("decimal(18,6)") * weight).cast("double") / F.sum(weight).cast("double")).alias("price"), F.count("*").alias("n_pairs"))


def fork_quantity(ledger: DataFrame, parent: str, day: str) -> DataFrame:
    """Net quantity of the parent asset before the fork, transfers included, derivatives not."""
    t = F.col("transaction_type")
    inward = t.isin(*S.ACQUISITIONS) | ((t == "TRANSFER") & (F.col("transfer_direction") == "IN"))
    x = ledger.where((F.col("asset") == parent) & (F.col("timestamp") < F.lit(day).cast("timestamp")) & ~S.is_perp(F.col("instrument_kind"), F.col("source")))
    return x.groupBy("asset").agg(F.sum(F.when(inward, S.units(F.col("amount"))).otherwise(-S.units(F.col("amount")))).alias("q")).select("asset", S.quantity(F.col("q")).alias("quantity"))
