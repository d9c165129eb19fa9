"""Reports put together from the engines, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger_ops as L
from ..operators import pairing as P
from . import uk_cgt as UK
from . import us_lots as US


def breakdown(lots: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open lots by time acquired, disposals by time descending): the lines of one disposal are summed, then rounded once."""
    d = m.groupBy("asset", "disposal_id", "disposed").agg(F.sum("qty_u").alias("q"), F.sum("proceeds_c").alias("p"), F.sum("cost_c").alias("c"), F.count_if(F.col("lot_id").isNull()).alias("n_uncovered"))
    d = d.select("asset", "disposal_id", "disposed", S.quantity(F.col("q")).alias("quantity"), S.money(F.col("p")).alias("proceeds"), S.money(F.col("c")).alias("cost"), S.money(F.col("p") - F.col("c")).alias("gain"), (F.col("n_uncovered") > 0).alias("missing_basis"))
    o = lots.select("asset", "id", "timestamp", S.quantity(F.col("qty_u")).alias("quantity"), S.money(F.col("cost_c")).alias("cost"))
    return o.orderBy("asset", "timestamp", "id"), d.orderBy("asset", F.col("disposed").desc(), "disposal_id")


def portfolio_totals(positions: DataFrame, dust: float = 0.5) -> DataFrame:
    """Value of all holdings; invested and unrealized of those that aren't dust; one row."""
    c = lambda n: F.round((F.coalesce(n, F.lit(0.0)) * 100).cast("decimal(38,4)"), 0)
    real = (F.col("market_value") >= dust) | (F.col("invested") >= dust)
    g = positions.agg(F.count("*").alias("n_assets"), F.sum(c("market_value")).alias("v"), F.sum(F.when(real, c("invested"))).alias("i"), F.sum(F.when(real, c("unrealized"))).alias("u"))
    return g.select("n_assets", *[(F.col(k) / 100).cast("double").alias(n) for k, n in (("v", "market_value"), ("i", "invested"), ("u", "unrealized"))])


def allocation(positions: DataFrame) -> DataFrame:
    """Share of the value of each asset that has any, in percent."""
    total = F.sum("market_value").over(Window.partitionBy(F.lit(0)))
    return positions.where("market_value > 0").select("asset", "market_value", F.round(F.col("market_value") / total * 100, 4).alias("percent"))


def uk_with_perps(rows: DataFrame, perps: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Capital gains rows with those of derivatives, for the policy that taxes their results as gains: results in proceeds, fees in cost."""
    p = L.perp_legs(perps, "GBP", rates).where("realized_pnl is not null")
    gbp = lambda c: (c / 100).cast("decimal(38,2)")
    day = S.uk_day(F.col("timestamp"))
    gain, fee = gbp(F.col("pnl_c")), gbp(F.col("fee_c"))
    new = p.select(
        "asset", day.alias("day"), S.uk_tax_year(day).alias("tax_year"), F.lit("perp").alias("match_type"), F.col("id").alias("disposal_id"), F.lit(None).cast("string").alias("acquisition_id"), F.col("amount").cast("decimal(38,8)").alias("quantity"),
        F.greatest(gain, F.lit(0)).alias("proceeds"), (fee + F.greatest(-gain, F.lit(0))).alias("cost"), (gain - fee).alias("gain"),
    )
    return rows.unionByName(new)


def data_health(ledger: DataFrame, m: DataFrame, min_gap_days: int = 7) -> DataFrame:
    """One feed of what is missing: disposals without basis, inflows without origin, gaps of venues; newest first inside a kind."""
    bare = m.where("lot_id is null").select(F.lit("missing_basis").alias("kind"), F.col("disposal_id").alias("ref"), "asset", F.to_date("disposed").alias("day"), S.quantity(F.col("qty_u")).alias("quantity"))
    orphan = L.orphan_inflows(ledger).select(F.lit("orphan_inflow").alias("kind"), F.col("id").alias("ref"), "asset", F.to_date("timestamp").alias("day"), F.col("amount").alias("quantity"))
    days = ledger.where("source is not null").groupBy(F.col("source").alias("key"), F.to_date("timestamp").alias("start_day")).agg(F.to_date(F.max("timestamp")).alias("end_day"))
    gaps = L.coverage_gaps(days, min_gap_days).select(F.lit("coverage_gap").alias("kind"), F.col("key").alias("ref"), F.lit(None).cast("string").alias("asset"), F.col("gap_start").alias("day"), F.col("gap_days").cast("double").alias("quantity"))
    return bare.unionByName(orphan).unionByName(gaps).orderBy("kind", F.col("day").desc(), "ref")


def write_csv(detail: DataFrame, summary: DataFrame, path: str) -> None:
    """Detail and summary as CSV with headers, in two folders under `path`."""
    flat = lambda df: df.select(*[F.array_join(c, "+").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat(detail).write.mode("overwrite").option("header", True).csv(f"{path}/detail")
    flat(summary).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def write_backup(ledger: DataFrame, overrides: DataFrame, path: str) -> None:
    """Ledger and overrides as JSON lines in two folders, and a description with the number of rows."""
    ledger.write.mode("overwrite").json(f"{path}/transactions")
    overrides.write.mode("overwrite").json(f"{path}/cost_basis_overrides")
    ledger.agg(F.lit("coinfold-backup").alias("format"), F.lit(1).alias("version"), F.count("*").alias("transaction_count")).write.mode("overwrite").json(f"{path}/description")


def read_backup(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/transactions")


def uk_report(ledger: DataFrame, year: str | None = None, rates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows, sums by year and closing pools of a ledger; transfers are paired first, the year filters only what is shown."""
    x = P.annotate(ledger, P.internal_transfers(ledger))
    engine = UK.uk_engine(UK.uk_legs(x, rates))
    rows = UK.cgt_rows(engine)
    shown = rows if year is None else rows.where(F.col("tax_year") == year)
    return {"rows": shown.orderBy("day", "asset", "disposal_id"), "by_year": UK.cgt_by_year(shown), "income": L.income_by_year(x, rates), "pools": UK.pools(engine)}


def us_report(ledger: DataFrame, method: str = "FIFO", year: int | None = None, to_ccy: str = "USD", rates: DataFrame | None = None) -> dict[str, DataFrame]:
    x = P.annotate(ledger, P.internal_transfers(ledger))
    m = US.matches(x, method, to_ccy, rates)
    shown = m if year is None else m.where(F.year("disposed") == year)
    return {"form_8949": US.form_8949(shown).orderBy("date_sold", "asset", "disposal_id"), "summary": US.realized_by_year_term(shown, True), "by_asset": US.realized_by_asset(shown)}
