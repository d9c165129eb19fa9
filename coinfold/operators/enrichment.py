"""Values for rows that came without one, from tables of prices.

`daily` has (asset, day, price) in US dollars, `spot` has (asset, price). Days are UTC's. A row without a price stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .classifiers import pair_values
from .ledger_ops import swap_basis
from .staking import withdrawals

# Bounds below which a value counts as missing, and the sources concerned.
LEAST_FEE, LEAST_INCOME, LEAST_STAKING = 0.01, 0.50, 1e-6
WALLETS = ("solana", "ethereum", "base", "arbitrum", "optimism", "polygon", "bitcoin", "cardano", "celestia")
INDEXERS = ("solana", "ethereum", "base", "arbitrum", "optimism", "polygon")
EXCHANGES = ("kraken", "binance", "cryptocom", "exchange", "mexc")


def _value() -> Column:
    return F.coalesce("fiat_value_at_trigger", F.lit(0.0))


#: Quantities of 19 digits before the point and prices of 18 places: tokens by the trillion at a price of 1e-9 are worth what they are worth.
QUANTITY, PRICE = "decimal(27,8)", "decimal(27,18)"


def _unit(c: str) -> Column:
    return F.col(c).try_cast(PRICE)


def revalue(ledger: DataFrame, which: Column, daily: DataFrame, spot: DataFrame | None = None, least: float = 0.01, spot_from: str | None = None, keep_currency: bool = False) -> DataFrame:
    """Gives the rows `which` quantity times the day's price, or else the spot price, to the cent; values below `least` are left out.

    spot_from: the first day on which a spot price is right; any day if not given. Only rows of `which` look prices up. A quantity or price beyond
    19 or 9 digits before the point gives no value.
    """
    day = F.to_date("timestamp")
    p = daily.groupBy(F.col("asset").alias("_asset"), F.col("day").alias("_day")).agg(F.max(_unit("price")).alias("_p"))
    x = ledger.withColumns({"_which": F.coalesce(which, F.lit(False)), "_on": day})
    x = x.join(p, F.col("_which") & (F.col("asset") == F.col("_asset")) & (F.col("_on") == F.col("_day")), "left").drop("_asset", "_day")
    price = F.col("_p")
    if spot is not None:
        s = spot.groupBy(F.col("asset").alias("_asset")).agg(F.max(_unit("price")).alias("_s"))
        x = x.join(s, F.col("_which") & (F.col("asset") == F.col("_asset")), "left").drop("_asset")
        now = F.lit(True) if spot_from is None else F.col("_on") >= F.lit(spot_from).cast("date")
        price = F.coalesce(price, F.when(now, F.col("_s")))
    v = F.round(F.col("amount").try_cast(QUANTITY) * F.when(price > 0, price), 2)
    found = F.col("_which") & F.coalesce(v >= F.lit(least).cast("decimal(12,4)"), F.lit(False))
    currency = F.coalesce("fiat_currency", F.lit("USD")) if keep_currency else F.lit("USD")
    x = x.withColumns({"fiat_value_at_trigger": F.when(found, v.cast("double")).otherwise(F.col("fiat_value_at_trigger")), "fiat_currency": F.when(found, currency).otherwise(F.col("fiat_currency"))})
    return x.select(*ledger.columns)


def fee_values(ledger: DataFrame, daily: DataFrame, spot: DataFrame | None = None) -> DataFrame:
    """Fees paid in a coin that isn't stable: a disposal at what it was worth."""
    which = (F.col("transaction_type") == "FEE") & (F.col("amount") > 0) & (_value() < LEAST_FEE) & ~S.is_stable(F.col("asset"))
    return revalue(ledger, which, daily, spot, LEAST_FEE, keep_currency=True)


def income_values(ledger: DataFrame, daily: DataFrame, spot: DataFrame | None = None) -> DataFrame:
    """Airdrops and rewards worth no more than the bound as booked; only values above it are kept."""
    which = F.col("transaction_type").isin(*S.INCOME) & (F.col("amount") > 0) & (_value() <= LEAST_INCOME)
    return revalue(ledger, which, daily, spot, LEAST_INCOME + 0.01)


def principal_groups(ledger: DataFrame) -> DataFrame:
    """Trade groups in which a reward comes together with a transfer in, the principal."""
    t = F.col("transaction_type")
    g = ledger.where("trade_group_id is not null").groupBy("trade_group_id").agg(F.bool_or(t == "STAKING").alias("s"), F.bool_or((t == "TRANSFER") & (F.col("transfer_direction") == "IN")).alias("p"))
    return g.where("s and p").select(F.col("trade_group_id").alias("_g"))


def wallet_values(ledger: DataFrame, daily: DataFrame, spot: DataFrame | None = None, today: str | None = None, wallets: tuple[str, ...] = WALLETS, indexers: tuple[str, ...] = INDEXERS) -> DataFrame:
    """Rows of wallets without a value, and all of indexers, whose values are estimates; returned principal keeps none.

    A spot price is right from `today` on only.
    """
    x = ledger.join(principal_groups(ledger), F.col("trade_group_id") == F.col("_g"), "left")
    back = F.col("_g").isNotNull() & (F.col("transaction_type") == "TRANSFER") & (F.col("transfer_direction") == "IN")
    which = F.col("source").isin(*wallets) & (F.col("amount") > 0) & ((_value() <= 0) | F.col("source").isin(*indexers)) & ~back
    return revalue(x, which, daily, spot, spot_from=today or "9999-12-31").select(*ledger.columns)


def staking_values(ledger: DataFrame, daily: DataFrame, spot: DataFrame | None = None, today: str | None = None, exchanges: tuple[str, ...] = EXCHANGES) -> DataFrame:
    """Rewards that an exchange booked without a value."""
    which = (F.col("transaction_type") == "STAKING") & (F.col("amount") >= LEAST_STAKING) & (_value() <= 0) & F.col("source").isin(*exchanges)
    return revalue(ledger, which, daily, spot, spot_from=today or "9999-12-31")


def leg_values(ledger: DataFrame, daily: DataFrame, spot: DataFrame | None = None) -> DataFrame:
    """Legs of a trade group that have no value at all."""
    return revalue(ledger, F.col("trade_group_id").isNotNull() & (F.col("amount") > 0) & (_value() <= 0) & ~S.is_stable(F.col("asset")), daily, spot)


def backfill(ledger: DataFrame, daily: DataFrame, spot: DataFrame | None = None, today: str | None = None) -> DataFrame:
    """All of it in order: withdrawals of stakes, basis from the other side, wallets, fees, rewards of exchanges, pairs of transfers."""
    x = swap_basis(withdrawals(ledger))
    return pair_values(staking_values(fee_values(wallet_values(x, daily, spot, today), daily, spot), daily, spot, today))


def resolve_prices(wanted: DataFrame, *ranked: tuple[str, DataFrame], floor: DataFrame | None = None) -> DataFrame:
    """(asset, price, price_source) for each wanted asset: from the first of the named tables (asset, price) that has it; null if none has.

    A table may say 0, for what can't be sold. floor: (asset, price) below which a price is taken for a slip and passed over.
    """
    x = wanted.select("asset").distinct()
    low = F.lit(0).cast(PRICE)
    if floor is not None:
        x = x.join(floor.groupBy("asset").agg(F.max(_unit("price")).alias("_low")), "asset", "left")
        low = F.coalesce("_low", low)
    for i, (_, t) in enumerate(ranked):
        x = x.join(t.groupBy("asset").agg(F.max(_unit("price")).alias(f"_{i}")), "asset", "left")
    ok = [(n, F.when(F.col(f"_{i}") >= low, F.col(f"_{i}"))) for i, (n, _) in enumerate(ranked)]
    source = F.coalesce(*[F.when(p.isNotNull(), F.lit(n)) for n, p in ok])
    return x.select("asset", F.coalesce(*[p for _, p in ok]).cast("double").alias("price"), source.alias("price_source"))


def unresolved(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Assets that still have no price."""
    return wanted.select("asset").distinct().join(resolved.where("price is not null").select("asset"), "asset", "left_anti")


def displayed(df: DataFrame, money: list[str], units: list[str], rate: float) -> DataFrame:
    """Money in another currency at one rate for all: amounts to 2 places, prices of a unit to 4."""
    r = F.lit(str(rate)).cast("decimal(12,8)")
    to = lambda c, n: F.round(F.col(c).cast("decimal(24,8)") * r, n).cast("double")
    return df.withColumns({**{c: to(c, 2) for c in money}, **{c: to(c, 4) for c in units}})
