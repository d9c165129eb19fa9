"""Rewrites of ledger rows by what their trade group shows. Each is idempotent and takes its policies as arguments.

Groups are looked at with windows on the trade group: one shuffle by the group serves all flags of a rewrite. Rows
without a group are passed on. Lists of addresses and assets are parameters; the defaults are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

NATIVE = ("SOL", "WSOL")
LIQUID = ("MSOL", "JITOSOL", "BSOL")
# Collateral assets, protocol programs and authorities.
COLLATERAL = (*NATIVE, *LIQUID, "USDC", "USDT", "PYUSD", "USDG")
MARGIN_PROGRAMS = ("dRiftyHA39MWEi3m9aunc5MzRF1JYuBsbn6VPcn33UH",)
LENDING_PROGRAMS = (
    "KLend2g3cP87fffoy8q1mQqGKjrxjC8boSyAYavgmjD", "9DrvZvyWh1HuAoZxvYWMvkf2XCzryCpGgHqrMjyDWpmo", "MFv2hWf31Z9kbCa1snEPYctwafyhdvnV7FZnsebVacA", "4qp6Fx6tnZkY5Wropq9wUYgtFxXKwE6viZxFHg3rdAG8",
    "KvauGMspG5k6rtzrqqn7WNn3oZdyKqLKwK2XWQ8FLjd", "FTj3SbJuawWT42Wj2GWxmbqLXNpXFE4ypE1bN17Sh5J5",
)
VAULT_SHARES = ("FiM4VQdXXnTXL7GgChryf9zHNG9cmvKECwf34L2y3CkN",)


def _group():
    return S.group_window("trade_group_id")


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(*names: str) -> Column:
    return F.col("transaction_type").isin(*names)


def _in_group(condition: Column) -> Column:
    """Whether any row of the trade group meets the condition; false without a group."""
    return F.col("trade_group_id").isNotNull() & (F.max(_yes(condition).cast("int")).over(_group()) == 1)


def _count(condition: Column) -> Column:
    return F.sum(_yes(condition).cast("int")).over(_group())


def _as_transfers(ledger: DataFrame, which: Column, subtype: str | None = None) -> DataFrame:
    """BUY rows that `which` picks come in, SELL rows go out."""
    hit = _yes(which) & _kind("BUY", "SELL")
    way = F.when(_kind("BUY"), "IN").otherwise("OUT")
    return ledger.withColumns({
        "transfer_direction": F.when(hit, way).otherwise(F.col("transfer_direction")), "counter_asset": F.when(hit, _nothing()).otherwise(F.col("counter_asset")),
        "venue_order_type": F.when(hit, F.lit(subtype)).otherwise(F.col("venue_order_type")) if subtype else F.col("venue_order_type"), "transaction_type": F.when(hit, "TRANSFER").otherwise(F.col("transaction_type")),
    })


def income(ledger: DataFrame, chain: str = "solana", max_native: float = 0.015, max_usd: float = 10.0) -> DataFrame:
    """Interest is not an airdrop; one token in for a priced pinch of the native coin is a claim (airdrop and fee), for more it is a trade."""
    interest = (F.col("source") == "cryptocom") & _kind("AIRDROP") & F.contains("id", F.lit("crypto_earn_interest_paid"))
    x = ledger.withColumn("transaction_type", F.when(_yes(interest), "STAKING").otherwise(F.col("transaction_type")))
    on, native, v = (F.col("source") == chain), F.upper("asset").isin(*NATIVE), F.coalesce("fiat_value_at_trigger", F.lit(0.0))
    token = ~native & ~S.is_stable(F.col("asset"))
    small = native & (F.col("amount") <= max_native) & (v <= max_usd) & (v > 0)
    size = _count(F.lit(True))
    claim = _yes(on) & F.col("trade_group_id").isNotNull() & (size <= 3) & (_count(_kind("BUY")) == 1) & (_count(_kind("SELL")) == 1) & (_count(_kind("BUY") & token) == 1) & (_count(_kind("SELL") & small) == 1)
    large = native & _kind("FEE") & ((F.col("amount") > max_native) | (v > max_usd))
    trade = _yes(on) & F.col("trade_group_id").isNotNull() & (size <= 3) & (_count(_kind("AIRDROP")) == 1) & (_count(_kind("AIRDROP") & token) == 1) & (_count(_kind("FEE") & native) == 1) & (_count(large) == 1)
    paid = F.max(F.when(native & _kind("FEE"), v)).over(_group())
    x = x.withColumns({"_claim": claim, "_trade": trade, "_paid": paid})
    t = F.col("transaction_type")
    return x.withColumns({
        "fiat_value_at_trigger": F.when(F.col("_trade") & (t == "AIRDROP") & (v <= 0), F.round("_paid", 2)).otherwise(F.col("fiat_value_at_trigger")),
        "counter_asset": F.when(F.col("_claim") & t.isin("BUY", "SELL"), _nothing()).otherwise(F.col("counter_asset")),
        "transaction_type": F.when(F.col("_claim") & (t == "BUY"), "AIRDROP").when(F.col("_claim") & (t == "SELL"), "FEE").when(F.col("_trade") & (t == "AIRDROP"), "BUY").when(F.col("_trade") & native & (t == "FEE"), "SELL").otherwise(t),
    }).drop("_claim", "_trade", "_paid")


def vaults(ledger: DataFrame, shares: tuple[str, ...] = VAULT_SHARES, receipts: DataFrame | None = None) -> DataFrame:
    """In a group that touches a vault share, share legs go and trades of the native coin become transfers at half their amount (wrapped
    and native coin are summed in one leg); in one that touches a farm receipt (receipts: token_mint), receipts go and the other trades become transfers."""
    mint = F.coalesce("token_mint", "asset")
    share = mint.isin(*shares)
    x = ledger
    if receipts is not None:
        r = receipts.select(F.col("token_mint").alias("_mint")).distinct().withColumn("_receipt", F.lit(True))
        x = x.join(r, x.token_mint == F.col("_mint"), "left").drop("_mint").withColumn("_receipt", _yes(F.col("_receipt")))
    else:
        x = x.withColumn("_receipt", F.lit(False))
    x = x.withColumns({"_vault": _in_group(share | F.col("counter_asset").isin(*shares)), "_farm": _in_group(F.col("_receipt") & _kind("BUY", "SELL"))})
    x = x.where(~(F.col("_vault") & _yes(share) & _kind("BUY", "SELL")) & ~(F.col("_farm") & F.col("_receipt") & _kind("BUY", "SELL")))
    native = F.col("_vault") & F.upper("asset").isin(*NATIVE)
    half = native & _kind("BUY", "SELL")
    x = x.withColumns({"amount": F.when(half, F.col("amount") / 2).otherwise(F.col("amount")), "fiat_value_at_trigger": F.when(half, F.round(F.col("fiat_value_at_trigger") / 2, 2)).otherwise(F.col("fiat_value_at_trigger"))})
    return _as_transfers(x, native | F.col("_farm")).drop("_vault", "_farm", "_receipt")


def lending(ledger: DataFrame, programs: tuple[str, ...] = LENDING_PROGRAMS, receipts: tuple[str, ...] = ()) -> DataFrame:
    """In a group under one on-chain id that touches a lending program or receipt, receipts go and the other trades become transfers."""
    receipt = F.coalesce("token_mint", "asset").isin(*receipts) if receipts else F.lit(False)
    touched = receipt | (F.col("counter_asset").isin(*receipts) if receipts else F.lit(False)) | F.col("counterparty_address").isin(*programs)
    ids = F.size(F.collect_set("on_chain_tx_id").over(_group())) == 1
    x = ledger.withColumns({"_hit": _in_group(touched) & ids, "_receipt": _yes(receipt)})
    x = x.where(~(F.col("_hit") & F.col("_receipt") & _kind("BUY", "SELL")))
    return _as_transfers(x, F.col("_hit")).drop("_hit", "_receipt")


def margin_collateral(ledger: DataFrame, programs: tuple[str, ...] = MARGIN_PROGRAMS, chain: str = "solana") -> DataFrame:
    """Trades of collateral assets with a margin program, or in a group that touches one, are transfers."""
    touched = F.col("counterparty_address").isin(*programs) | (F.col("venue_order_type") == "collateral")
    which = (F.col("source") == chain) & F.upper("asset").isin(*COLLATERAL) & (_yes(touched) | _in_group(touched))
    return _as_transfers(ledger.withColumn("_hit", _yes(which)), F.col("_hit")).drop("_hit")


def lending_for_tax(ledger: DataFrame, policy: str = "cgt_disposal", programs: tuple[str, ...] = LENDING_PROGRAMS, shares: tuple[str, ...] = VAULT_SHARES) -> DataFrame:
    """Transfers to a protocol are disposals, those from it acquisitions, unless the policy is basis_neutral."""
    if policy != "cgt_disposal":
        return ledger
    hit = _kind("TRANSFER") & (F.col("event_subtype").isin("lend_deposit", "lend_withdraw") | F.col("counterparty_address").isin(*programs) | F.col("token_mint").isin(*shares))
    x = ledger.withColumn("_way", F.when(_yes(hit), F.col("transfer_direction")))
    done = F.col("_way").isin("OUT", "IN")
    return x.withColumns({
        "transaction_type": F.when(F.col("_way") == "OUT", "SELL").when(F.col("_way") == "IN", "BUY").otherwise(F.col("transaction_type")), "event_subtype": F.when(F.col("_way") == "OUT", "lend_deposit").when(F.col("_way") == "IN", "lend_withdraw").otherwise(F.col("event_subtype")),
        "transfer_direction": F.when(done, _nothing()).otherwise(F.col("transfer_direction")), "transfer_pair_id": F.when(done, _nothing()).otherwise(F.col("transfer_pair_id")),
    }).drop("_way")


def liquidity_for_tax(ledger: DataFrame, policy: str = "cgt_disposal", share_mints: tuple[str, ...] = (), programs: tuple[str, ...] = LENDING_PROGRAMS) -> DataFrame:
    """Groups that put two assets and more into a pool dispose of them for a pool share, those that take them out do the reverse.

    A share leg is one of `share_mints`; one share leg and one other leg are enough. A group without a share leg in gets a synthetic share
    LP:<group>, amount 1, worth what went in. `liquidity.inferred_burns` then adds the sales of shares that have no leg.
    """
    if policy != "cgt_disposal":
        return ledger
    gid = F.col("trade_group_id")
    way = F.when(_kind("TRANSFER"), F.col("transfer_direction")).when(_kind("SELL"), "OUT").when(_kind("BUY"), "IN")
    share = _yes(F.coalesce("token_mint", "asset").isin(*share_mints)) if share_mints else F.lit(False)
    leg = ~S.is_perp(F.col("instrument_kind"), F.col("source")) & way.isNotNull()
    p_out, p_in, s_out, s_in = (_count(leg & (way == w) & (share if s else ~share)) for s, w in ((0, "OUT"), (0, "IN"), (1, "OUT"), (1, "IN")))
    barred = _count(F.col("event_subtype").isNotNull() | F.col("counterparty_address").isin(*programs)) > 0
    add = (p_in == 0) & ((p_out >= 2) | ((s_in > 0) & (p_out > 0)))
    remove = (p_out == 0) & ((p_in >= 2) | ((s_out > 0) & (p_in > 0)))
    x = ledger.withColumns({"_way": way, "_share": share, "_leg": _yes(leg)})
    x = x.withColumn("_do", F.when(gid.isNull() | barred, _nothing()).when(add, "lp_add").when(remove, "lp_remove"))
    v = F.coalesce("fiat_value_at_trigger", F.lit(0.0))
    main = F.col("_leg") & ~F.col("_share")
    x = x.withColumns({"_total": F.round(F.sum(F.when(main, v).otherwise(0.0)).over(_group()), 2), "_shares": _count(F.col("_leg") & F.col("_share")), "_n": F.row_number().over(Window.partitionBy("trade_group_id", F.when(gid.isNull(), F.col("id")), main).orderBy("timestamp", "id"))})
    hit = F.col("_do").isNotNull() & F.col("_leg")
    new = x.where(hit & main & (F.col("_do") == "lp_add") & (F.col("_shares") == 0) & (F.col("_n") == 1)).withColumns({
        "id": F.concat(F.lit("lp-acquire-"), gid), "asset": F.concat(F.lit("LP:"), F.upper(gid)), "transaction_type": F.lit("BUY"), "amount": F.lit(1.0), "fiat_value_at_trigger": F.col("_total"), "fee_fiat": F.lit(0.0), "event_subtype": F.lit("lp_add"),
        "transfer_direction": _nothing(), "transfer_pair_id": _nothing(), "counter_asset": _nothing(), "token_mint": _nothing(), "counter_amount": F.lit(None).cast("double"),
    }).select(*ledger.columns)
    done = x.withColumns({
        "fiat_value_at_trigger": F.when(hit & F.col("_share") & (F.col("_total") > 0.005) & ((F.col("_do") == "lp_add") | (v < 0.01)), F.col("_total")).otherwise(F.col("fiat_value_at_trigger")),
        "transaction_type": F.when(hit, F.when(F.col("_way") == "OUT", "SELL").otherwise("BUY")).otherwise(F.col("transaction_type")), "event_subtype": F.when(hit, F.col("_do")).otherwise(F.col("event_subtype")),
        "transfer_direction": F.when(hit, _nothing()).otherwise(F.col("transfer_direction")), "transfer_pair_id": F.when(hit, _nothing()).otherwise(F.col("transfer_pair_id")), "counter_asset": F.when(hit, _nothing()).otherwise(F.col("counter_asset")),
    }).select(*ledger.columns)
    return done.unionByName(new)


def hard_forks(ledger: DataFrame, events: DataFrame, policy: str = "fmv") -> DataFrame:
    """Adds a purchase of the forked coin for what was held of its parent at the fork's midnight UTC, unless one is booked.

    events: asset, parent, day (date), ratio, price (USD, may be null). policy zero books no value.
    """
    way = F.when(_kind(*S.ACQUISITIONS) | (_kind("TRANSFER") & (F.col("transfer_direction") == "IN")), F.col("amount")).otherwise(-F.col("amount"))
    e = F.broadcast(events.select(F.col("asset").alias("fork"), F.col("parent").alias("root"), "day", "ratio", "price"))
    spot = ledger.where(~S.is_perp(F.col("instrument_kind"), F.col("source")))
    held = spot.join(e, (F.col("asset") == F.col("root")) & (F.col("timestamp") < F.col("day").cast("timestamp"))).groupBy("fork", "root", "day", "ratio", "price").agg(F.sum(way).alias("net"))
    booked = ledger.where((F.col("event_subtype") == "hard_fork") | F.startswith("id", F.lit("hard-fork-"))).select(F.col("asset").alias("fork")).distinct()
    q = F.round(F.col("net") * F.col("ratio"), 8)
    value = F.lit(0.0) if policy == "zero" else F.round(q * F.coalesce("price", F.lit(0.0)), 2)
    new = held.where(q > 1e-9).join(booked, "fork", "left_anti").select(
        F.concat_ws("-", F.lit("hard-fork"), F.lower("fork"), "day").alias("id"), F.col("day").cast("timestamp").alias("timestamp"), F.col("fork").alias("asset"), F.lit("BUY").alias("transaction_type"), q.alias("amount"), value.alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"),
        F.when(value > 0, "USD").alias("fiat_currency"), F.lit("hard_fork").alias("source"), F.lit("hard_fork").alias("event_subtype"), F.col("root").alias("parent_asset"),
    )
    return ledger.unionByName(new, allowMissingColumns=True)


def disguised_swaps(ledger: DataFrame) -> DataFrame:
    """One transfer out and one in of different assets under one on-chain id are a sale and a purchase."""
    w = S.group_window("on_chain_tx_id")
    t = _kind("TRANSFER")
    n = lambda c: F.sum(_yes(c).cast("int")).over(w)
    swap = F.col("on_chain_tx_id").isNotNull() & (n(t & (F.col("transfer_direction") == "OUT")) == 1) & (n(t & (F.col("transfer_direction") == "IN")) == 1) & (n(F.lit(True)) == n(t)) & (F.min("asset").over(w) != F.max("asset").over(w))
    x = ledger.withColumn("_swap", _yes(swap) & t)
    return x.withColumns({"transaction_type": F.when(F.col("_swap"), F.when(F.col("transfer_direction") == "OUT", "SELL").otherwise("BUY")).otherwise(F.col("transaction_type")), "transfer_direction": F.when(F.col("_swap"), _nothing()).otherwise(F.col("transfer_direction"))}).drop("_swap")


def pair_values(ledger: DataFrame, indexers: tuple[str, ...] = ("solana", "ethereum")) -> DataFrame:
    """Legs of a pair without value take that of the leg that has one, by the ratio of amounts; venues are trusted before indexers."""
    w = S.group_window("transfer_pair_id")
    v = F.coalesce("fiat_value_at_trigger", F.lit(0.0))
    donor = F.max(F.when(v >= 0.01, F.struct((~_yes(F.col("source").isin(*indexers))).cast("int").alias("rank"), v.alias("v"), "amount", "fiat_currency"))).over(w)
    x = ledger.withColumn("_d", F.when(F.col("transfer_pair_id").isNotNull(), donor))
    need = F.col("_d").isNotNull() & (v < 0.01) & (F.col("_d.amount") > 0)
    return x.withColumns({"fiat_currency": F.when(need, F.col("_d.fiat_currency")).otherwise(F.col("fiat_currency")), "fiat_value_at_trigger": F.when(need, S.money(S.share(S.cents(F.col("_d.v")), S.units(F.col("amount")), S.units(F.col("_d.amount"))))).otherwise(F.col("fiat_value_at_trigger"))}).drop("_d")


def timezone_copies(ledger: DataFrame) -> DataFrame:
    """Rows of a venue that repeat an earlier one 3,500 to 3,700 seconds later go: an export in another time zone was imported too.

    A row that goes hides no other: of a chain an hour apart each, every second one goes.
    """
    key = ["source", "asset", "transaction_type", "amount", "fiat_value_at_trigger", "counter_asset", "transfer_direction"]
    # Rows of other venues repeat nothing and stay where they lie.
    some = F.coalesce(F.col("source").isin("binance", "exchange"), F.lit(True))
    w = Window.partitionBy(*key).orderBy("timestamp", "seq", "id")
    gap = F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(w))
    x = ledger.where(some).withColumn("_next", _yes((gap >= 3500) & (gap <= 3700)) & F.col("source").isin("binance", "exchange"))
    x = x.withColumn("_run", F.sum((~F.col("_next")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*key, "_run").orderBy("timestamp", "seq", "id"))
    return ledger.where(~some).unionByName(x.withColumn("_place", place).where(F.col("_place") % 2 == 1).select(*ledger.columns))


def normalise(ledger: DataFrame, forks: DataFrame | None = None, lending_policy: str = "cgt_disposal", lp_policy: str = "cgt_disposal", **mints) -> DataFrame:
    """The rewrites in their fixed order."""
    x = timezone_copies(income(ledger))
    x = margin_collateral(disguised_swaps(lending(vaults(x, receipts=mints.get("farm_receipts")), receipts=mints.get("lending_receipts", ()))))
    x = liquidity_for_tax(lending_for_tax(x, lending_policy), lp_policy, mints.get("lp_shares", ()))
    return hard_forks(x, forks) if forks is not None else x
