"""Scalar rules of the ledger as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Stablecoins, fiat currencies and the fallback rates to GBP.
STABLES = ("USDT", "USDT0", "USDC", "DAI", "TUSD", "USDP", "PYUSD", "BUSD")
FIATS = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF", "NZD", "SGD", "HKD", "NOK", "SEK")
TO_GBP = {"GBP": 1.0, "USD": 0.79, "EUR": 0.86, "JPY": 0.0053, "CAD": 0.58, "AUD": 0.52, "CHF": 0.90}
# Types and legacy derivative venues.
ACQUISITIONS = ("BUY", "AIRDROP", "STAKING")
DISPOSALS = ("SELL", "FEE")
INCOME = ("AIRDROP", "STAKING")
PERP_SOURCES = ("woox", "hyperliquid", "variational", "drift")
# UK annual exempt amounts by tax year; any other year has the default.
EXEMPT = {"2019/20": 12000, "2020/21": 12300, "2021/22": 12300, "2022/23": 12300, "2023/24": 6000}
EXEMPT_DEFAULT = 3000
LOT_EPS, QTY_EPS = 1e-6, 1e-9


def normalise_asset(asset: Column) -> Column:
    """Trimmed; mint-like names of 32 and more letters and digits keep their case, others are upper case; empty: null."""
    x = F.trim(asset)
    return F.when(x == "", None).when((F.length(x) >= 32) & x.rlike("^[A-Za-z0-9]+$"), x).otherwise(F.upper(x))


def is_stable(asset: Column) -> Column:
    return F.coalesce(F.translate(F.upper(F.trim(asset)), "₮", "T").isin(*STABLES), F.lit(False))


def resolve_currency(currency: Column, source: Column) -> Column:
    c = F.upper(F.trim(currency))
    return F.when(c.isNull(), F.when(source == "kraken", "GBP").otherwise("USD")).when(is_stable(c), "USD").when(c.isin(*FIATS), c).otherwise("USD")


def fallback_rate(from_ccy: Column, to_ccy: Column) -> Column:
    """Rate by way of GBP; a currency without a rate counts as USD."""
    rates = F.create_map(*[F.lit(x) for kv in TO_GBP.items() for x in kv])
    to_gbp = lambda c: F.coalesce(F.try_element_at(rates, c), F.lit(TO_GBP["USD"]))
    return to_gbp(from_ccy) / to_gbp(to_ccy)


def fixed_rate(from_ccy: Column, to_ccy: str) -> Column:
    """The fallback rate as a decimal of 8 places; a currency without a rate counts as USD."""
    rate = {c: (Decimal(str(r)) / Decimal(str(TO_GBP[to_ccy]))).quantize(Decimal("1e-8"), ROUND_HALF_UP) for c, r in TO_GBP.items()}
    one = lambda x: F.lit(x).cast("decimal(12,8)")
    return F.coalesce(F.try_element_at(F.create_map(*[x for c, r in rate.items() for x in (F.lit(c), one(r))]), from_ccy), one(rate["USD"]))


def converted(value: Column, rate: Column) -> Column:
    """Money at a rate as whole cents, half up; null counts as 0."""
    x = F.coalesce(value, F.lit(0.0)).cast("decimal(24,6)") * rate
    return (F.round(x, 2) * 100).cast("decimal(38,0)")


def uk_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Europe/London"))


def uk_tax_year(day: Column) -> Column:
    """'2024/25' for 6 April 2024 to 5 April 2025."""
    y = F.year(day) - F.when(F.date_format(day, "MMdd") < "0406", 1).otherwise(0)
    return F.format_string("%d/%02d", y, (y + 1) % 100)


def exempt_amount(tax_year: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXEMPT.items() for x in kv]), tax_year), F.lit(EXEMPT_DEFAULT))


def holding_term(acquired: Column, disposed: Column) -> Column:
    """LONG from the day after the anniversary; 29 February has its anniversary on the 28th."""
    return F.when(F.to_date(disposed) >= F.date_add(F.add_months(F.to_date(acquired), 12), 1), "LONG").otherwise("SHORT")


def is_perp(kind: Column, source: Column) -> Column:
    return F.when(kind.isNotNull(), kind == "perp").otherwise(F.coalesce(F.lower(source).isin(*PERP_SOURCES), F.lit(False)))


def cents(value: Column) -> Column:
    """Money as whole cents, half up, exact under sums in any order."""
    return F.round(value.cast("decimal(30,6)") * 100, 0).cast("decimal(38,0)")


def units(quantity: Column) -> Column:
    """Quantity as whole 1e-8 units."""
    return (quantity.cast("decimal(38,8)") * 100000000).cast("decimal(38,0)")


def share(total: Column, part: Column, whole: Column) -> Column:
    """total * part / whole in whole numbers, half away from zero; 0 if whole is 0. Exact for results of up to 32 digits."""
    twice = (F.abs(total) * part * 2).cast("decimal(38,0)")
    q = F.floor((twice + whole).cast("decimal(38,0)") / F.nullif(whole * 2, F.lit(0)))
    return F.coalesce(F.sign(total).cast("int") * q, F.lit(0)).cast("decimal(38,0)")


def money(c: Column) -> Column:
    return (c / 100).cast("double")


def quantity(u: Column) -> Column:
    return (u.cast("double") / 1e8).cast("double")


def group_window(key: str) -> WindowSpec:
    """A window over the rows that share the key. Rows without one stand alone, so they don't meet in one task."""
    return Window.partitionBy(key, F.when(F.col(key).isNull(), F.col("id")))
