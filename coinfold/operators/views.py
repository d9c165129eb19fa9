"""Filters, counts and selections behind the ledger's views, and small repairs of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ledger_ops import is_dust, is_spam, new_rows

# The chain's own assets, bounds of its spam rules, forms of on-chain ids.
CORE = ("SOL", "WSOL", "BTC", "ETH")
SWAP_VALUE, HUGE = 0.5, 10_000
EVM_HASH = r"^0x[0-9a-fA-F]{64}$"
SIGNATURE = r"^[1-9A-HJ-NP-Za-km-z]{64,}$"
HASH_IN_ID = r"^cryptocom-.*?((?:0x)?[0-9A-Za-z]{42,})"


def visible(ledger: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows whose asset isn't in `hidden` (asset), whatever the case."""
    return ledger.join(hidden.select(F.upper(F.trim("asset")).alias("_h")).distinct(), F.upper("asset") == F.col("_h"), "left_anti")


def without_demo(ledger: DataFrame, demo: DataFrame, mode: str = "real") -> DataFrame:
    """The ledger by mode: `real` leaves out the ids of the demo, `demo` has only them, `all` is all."""
    if mode == "all":
        return ledger
    return ledger.join(demo.select("id").distinct(), "id", "left_anti" if mode == "real" else "left_semi").select(*ledger.columns)


def of_import(ledger: DataFrame, ref: str, demo: DataFrame | None = None) -> DataFrame:
    """Rows of an import: by its id, `legacy:<source>` for rows without one, or `demo`."""
    if ref == "demo":
        return ledger.limit(0) if demo is None else without_demo(ledger, demo, "demo")
    if ref.startswith("legacy:"):
        return ledger.where(F.col("import_id").isNull() & (F.lower("source") == ref.removeprefix("legacy:").lower()))
    return ledger.where(F.col("import_id") == ref)


def tagged(ledger: DataFrame, import_id: str, label: str | None = None) -> DataFrame:
    """The rows under an import's id, with its label as source where they have none."""
    return ledger.withColumns({"import_id": F.lit(import_id), "source": F.coalesce("source", F.lit(label))})


def appended(ledger: DataFrame, incoming: DataFrame, demo: DataFrame) -> DataFrame:
    """An import put to the ledger: the demo's rows go, and only rows that aren't there yet come."""
    real = without_demo(ledger, demo)
    return real.unionByName(new_rows(incoming, real))


def chain_spam(ledger: DataFrame, listed: DataFrame, chain: str = "solana") -> DataFrame:
    """`ledger` with `is_spam` for rows of a chain: labels that advertise, tokens that no list (mint, symbol) has unless they were traded at a value or
    for a named counter asset, and trades without value or counter leg that stand in a group or are of absurd size. Legs of liquidity stay."""
    x = ledger.join(listed.select(F.col("mint").alias("_m")).where("_m is not null").distinct(), F.col("token_mint") == F.col("_m"), "left")
    x = x.join(listed.select(F.upper("symbol").alias("_s")).where("_s is not null").distinct(), F.upper("asset") == F.col("_s"), "left")
    t, v = F.col("transaction_type"), F.coalesce("fiat_value_at_trigger", F.lit(0.0))
    core = F.upper("asset").isin(*CORE) | S.is_stable(F.col("asset"))
    long_name = F.length(F.coalesce("token_mint", F.lit(""))) >= 32
    unknown = ~core & F.col("_m").isNull() & F.col("_s").isNull() & (long_name | F.col("asset").rlike("^[1-9A-HJ-NP-Za-km-z]{32,}$"))
    traded, counter = t.isin("BUY", "SELL"), F.coalesce(F.length("counter_asset") > 0, F.lit(False))
    bare = traded & (v <= SWAP_VALUE) & ~counter & (F.coalesce(F.length("trade_group_id") > 0, F.lit(False)) | ((F.col("amount") > HUGE) & (F.length("asset") <= 12)))
    rule = F.when(is_spam(F.col("asset")), True).when(unknown, (t == "TRANSFER") | ~(traded & ((v >= SWAP_VALUE) | counter))).otherwise(bare)
    pool = F.coalesce(F.col("venue_order_type").isin("amm_lp", "amm_lp_pool"), F.lit(False))
    return x.withColumn("is_spam", F.coalesce((F.col("source") == chain) & ~pool & rule, F.lit(False))).select(*ledger.columns, "is_spam")


def liquidity_notes(ledger: DataFrame) -> DataFrame:
    """(id, asset, note, ambiguous): removals of liquidity that were inferred; ambiguous if their note asks to verify."""
    x = ledger.where("event_subtype = 'lp_remove' and normalization_note <> ''")
    return x.select("id", "asset", F.col("normalization_note").alias("note"), F.contains(F.lower("normalization_note"), F.lit("verify")).alias("ambiguous"))


def counts(ledger: DataFrame) -> DataFrame:
    """(facet, value, n): how many rows each source, type and asset has; a null value is one of its own."""
    x = ledger.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("source", "source"), ("type", "transaction_type"), ("asset", "asset"))])).alias("x"))
    return x.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def periods(ledger: DataFrame) -> DataFrame:
    """(kind, period): the calendar and UK tax years with rows in them, latest first."""
    y = ledger.select(F.lit("calendar").alias("kind"), F.year("timestamp").cast("string").alias("period"))
    u = ledger.select(F.lit("uk").alias("kind"), S.uk_tax_year(S.uk_day(F.col("timestamp"))).alias("period"))
    return y.unionByName(u).where("period is not null").distinct().orderBy("kind", F.col("period").desc())


def by_gain(realized: DataFrame) -> DataFrame:
    """Realized results from the largest gain or loss down."""
    return realized.orderBy(F.abs("realized_pnl").desc(), "asset")


def preview(df: DataFrame, rows: int = 3, columns: int = 8, width: int = 48) -> DataFrame:
    """The first rows and columns of an upload as text, long cells cut."""
    return df.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in df.columns[:columns]]).limit(rows)


def newest(ledger: DataFrame, n: int = 3) -> DataFrame:
    """The newest n rows of each source."""
    w = Window.partitionBy("source").orderBy(F.col("timestamp").desc_nulls_last(), F.col("seq").desc(), "id")
    return ledger.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def ordered_overlaps(overlaps: DataFrame) -> DataFrame:
    """Overlaps of imports, those that share rows first, then by how many and how many days, then by name."""
    kind = F.when(F.col("shared") > 0, "duplicate").otherwise("dates")
    return overlaps.withColumn("kind", kind).orderBy(F.col("kind") != "duplicate", F.col("shared").desc(), F.col("overlap_days").desc(), "source", "a_id", "b_id")


def earlier_import(ledger: DataFrame, gaps: DataFrame) -> DataFrame:
    """(asset, before, import_id, end_day): for each (asset, before), the import with that asset that ended last before the day; null if there is none."""
    ends = ledger.where("import_id is not null").groupBy("import_id").agg(F.max(F.to_date("timestamp")).alias("end_day"))
    has = ledger.where("import_id is not null").select("import_id", "asset").distinct().join(ends, "import_id")
    found = gaps.select("asset", "before").distinct().join(has, "asset", "left")
    best = F.max(F.when(F.col("end_day") < F.col("before"), F.struct("end_day", "import_id")))
    return found.groupBy("asset", "before").agg(best.alias("b")).select("asset", "before", F.col("b.import_id").alias("import_id"), F.col("b.end_day").alias("end_day"))


def order_groups(perps: DataFrame) -> DataFrame:
    """Derivatives' fills by source and order: (source, trade_group_id, n_fills, quantity, value_c, fee_c, pnl_c, first_at) from `perp_legs`."""
    g = perps.where("trade_group_id is not null").groupBy("source", "trade_group_id")
    return g.agg(F.count("*").alias("n_fills"), S.quantity(F.sum(S.units(F.col("amount")))).alias("quantity"), S.money(F.sum("notional_c")).alias("value"), S.money(F.sum("fee_c")).alias("fee"), S.money(F.sum("pnl_c")).alias("pnl"), F.min("timestamp").alias("first_at"))


def holdings(positions: DataFrame) -> DataFrame:
    """Sums over coins that aren't stable: one row (n, invested, market_value, gain, gain_percent)."""
    c = lambda n: F.round(F.coalesce(F.col(n), F.lit(0.0)).cast("decimal(24,4)") * 100, 0).cast("decimal(38,0)")
    g = positions.where(~S.is_stable(F.col("asset"))).agg(F.count("*").alias("n"), F.sum(c("invested")).alias("i"), F.sum(c("market_value")).alias("v"))
    gain = F.col("v") - F.col("i")
    percent = F.when(F.col("i") > 0, F.round((gain * 10000).cast("decimal(38,4)") / F.col("i"), 0).cast("double") / 100).otherwise(0.0)
    return g.select("n", S.money(F.col("i")).alias("invested"), S.money(F.col("v")).alias("market_value"), S.money(gain).alias("gain"), percent.alias("gain_percent"))


def acquisitions(ledger: DataFrame, asset: str) -> DataFrame:
    """Where an asset came from: purchases, income and transfers in, without dust, in order of time."""
    t = F.col("transaction_type")
    return ledger.where((F.col("asset") == asset) & (t.isin(*S.ACQUISITIONS) | ((t == "TRANSFER") & (F.col("transfer_direction") == "IN"))) & ~is_dust()).orderBy("timestamp", "id")


def on_chain_id() -> Column:
    """A row's on-chain id, or the one that its trade group or id shows."""
    gid, source = F.nullif(F.trim("trade_group_id"), F.lit("")), F.coalesce("source", F.lit(""))
    plain = source.isin("bitcoin", "cardano") & (F.length(gid) >= 32)
    shown = F.when(gid.rlike(EVM_HASH) | ((source == "solana") & gid.rlike(SIGNATURE)) | plain | ((source == "celestia") & ~F.startswith(F.lower(gid), F.lit("0x"))), gid)
    return F.coalesce(F.nullif("on_chain_tx_id", F.lit("")), shown, F.nullif(F.regexp_extract("id", HASH_IN_ID, 1), F.lit("")))


def with_on_chain_ids(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("on_chain_tx_id", on_chain_id())


def repaired_groups(ledger: DataFrame, chain: str = "solana") -> DataFrame:
    """The on-chain id as trade group where both differ and the row's id holds the former."""
    wrong = (F.col("source") == chain) & (F.length("trade_group_id") > 0) & (F.length("on_chain_tx_id") > 0) & (F.col("on_chain_tx_id") != F.col("trade_group_id")) & F.contains("id", F.col("on_chain_tx_id"))
    return ledger.withColumn("trade_group_id", F.when(F.coalesce(wrong, F.lit(False)), F.col("on_chain_tx_id")).otherwise(F.col("trade_group_id")))
