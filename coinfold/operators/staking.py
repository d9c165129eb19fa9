"""Staking: withdrawals told from rewards, yield of liquid staking, rows that belong together in time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from .ledger_ops import with_rate


def withdrawals(ledger: DataFrame, chains: tuple[str, ...] = ("ethereum", "base", "arbitrum", "optimism", "polygon")) -> DataFrame:
    """In a group of transfers in without a sale, a leg that equals the latest earlier transfer out of its chain, asset and amount is
    principal; the others are rewards. If none is matched, the largest leg is principal."""
    t = F.col("transaction_type")
    way = F.when(t == "TRANSFER", F.col("transfer_direction"))
    x = ledger.withColumn("_way", F.when(F.col("source").isin(*chains), way))
    back = Window.partitionBy("source", "asset", "amount", "token_mint").orderBy("timestamp", F.col("_way") != "OUT", "seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    g = S.group_window("trade_group_id")
    x = x.withColumn("_earlier", F.last(F.when(F.col("_way") == "OUT", F.col("timestamp")), True).over(back))
    x = x.withColumns({"_ins": F.sum(F.when(F.col("_way") == "IN", 1).otherwise(0)).over(g), "_sells": F.sum(F.when(t == "SELL", 1).otherwise(0)).over(g), "_hits": F.sum(F.when((F.col("_way") == "IN") & F.col("_earlier").isNotNull(), 1).otherwise(0)).over(g), "_largest": F.max(F.when(F.col("_way") == "IN", F.struct("amount", "id"))).over(g)})
    principal = F.when(F.col("_hits") > 0, F.col("_earlier").isNotNull()).otherwise(F.col("_largest.id") == F.col("id"))
    reward = F.col("trade_group_id").isNotNull() & (F.col("_way") == "IN") & (F.col("_ins") >= 2) & (F.col("_sells") == 0) & ~principal
    reward = F.coalesce(reward, F.lit(False))
    return x.withColumns({"transaction_type": F.when(reward, "STAKING").otherwise(t), "transfer_direction": F.when(reward, F.lit(None).cast("string")).otherwise(F.col("transfer_direction"))}).select(*ledger.columns)


def liquid_yield(ledger: DataFrame, liquid: tuple[str, ...] = ("MSOL", "JITOSOL", "BSOL"), native: tuple[str, ...] = ("SOL", "WSOL")) -> DataFrame:
    """Sales of a liquid staking token for more of the native coin than was put in: the excess becomes a staking reward
    (<id>-lst-yield) and the purchase keeps the principal.

    What was put in follows first in, first out from the purchases of the token in trade groups with the native coin: both lie on the axis
    of the token's quantity, and a sale's principal is the native quantity at its end less that at its begin.
    """
    t, a = F.col("transaction_type"), F.upper("asset")
    g = ledger.where("trade_group_id is not null").groupBy("trade_group_id").agg(
        F.max(F.when(a.isin(*liquid), a)).alias("token"), F.min("timestamp").alias("at"), F.sum(F.when(a.isin(*liquid) & (t == "BUY"), F.col("amount"))).alias("got"), F.sum(F.when(a.isin(*native) & (t == "SELL"), F.col("amount"))).alias("paid"),
        F.sum(F.when(a.isin(*liquid) & (t == "SELL"), F.col("amount"))).alias("sold"), F.sum(F.when(a.isin(*native) & (t == "BUY"), F.col("amount"))).alias("back"),
    ).where("token is not null")
    w = Window.partitionBy("token").orderBy("at", "trade_group_id").rowsBetween(Window.unboundedPreceding, 0)
    buys = g.where("got > 0 and paid > 0").withColumns({"hi": F.sum("got").over(w), "native_hi": F.sum("paid").over(w)})
    buys = buys.select("token", (F.col("hi") - F.col("got")).alias("lo"), "hi", (F.col("native_hi") - F.col("paid")).alias("native_lo"), (F.col("paid") / F.col("got")).alias("rate"))
    sales = g.where("sold > 0 and back > 0").withColumn("end", F.sum("sold").over(w)).select("token", "trade_group_id", "back", "sold", F.col("end"), (F.col("end") - F.col("sold")).alias("start"))
    points = sales.select("token", "trade_group_id", "back", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("start").alias("p")), F.struct(F.lit(1).alias("k"), F.col("end").alias("p")))).alias("x")).select("token", "trade_group_id", "back", "x.k", "x.p")
    marks = buys.select("token", F.col("lo").alias("p"), F.lit(-1).alias("k"), F.struct("lo", "hi", "native_lo", "rate").alias("lot"), F.lit(None).cast("string").alias("trade_group_id"), F.lit(None).cast("double").alias("back"))
    o = Window.partitionBy("token").orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(points, allowMissingColumns=True).withColumn("lot", F.last("lot", True).over(o)).where("k >= 0")
    put = F.col("lot.native_lo") + (F.least("p", "lot.hi") - F.col("lot.lo")) * F.col("lot.rate")
    cost = seen.groupBy("trade_group_id").agg((F.max(F.when(F.col("k") == 1, put)) - F.max(F.when(F.col("k") == 0, put))).alias("principal"), F.max("back").alias("back")).where("principal > 0 and back - principal > 1e-9")
    cost = cut(cost)
    x = ledger.join(cost.select(F.col("trade_group_id").alias("_g"), "principal", "back"), F.col("trade_group_id") == F.col("_g"), "left")
    done = ledger.where(F.endswith("id", F.lit("-lst-yield"))).select(F.col("trade_group_id").alias("_done")).distinct()
    x = x.join(done, F.col("trade_group_id") == F.col("_done"), "left").withColumn("_split", F.col("_g").isNotNull() & F.col("_done").isNull() & a.isin(*native) & (t == "BUY"))
    keep = F.col("principal") / F.col("back")
    # Part 0 is the row itself, part 1 its yield.
    x = x.withColumn("_part", F.explode(F.when(F.col("_split"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    more = F.col("_part") == 1
    ratio = F.when(F.col("_split"), F.when(more, 1 - keep).otherwise(keep))
    # Cut, since the result joined with itself again (a second pass) resolves columns of the exploded rows wrongly.
    return cut(x.withColumns({
        "id": F.when(more, F.concat("id", F.lit("-lst-yield"))).otherwise(F.col("id")), "transaction_type": F.when(more, "STAKING").otherwise(F.col("transaction_type")), "amount": F.when(ratio.isNotNull(), F.round(F.col("amount") * ratio, 9)).otherwise(F.col("amount")),
        "fiat_value_at_trigger": F.when(ratio.isNotNull(), F.round(F.col("fiat_value_at_trigger") * ratio, 2)).otherwise(F.col("fiat_value_at_trigger")), "fee_fiat": F.when(more, 0.0).otherwise(F.col("fee_fiat")),
    }).select(*ledger.columns))


def _clusters(seconds: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "id"], kind="stable")
        out, anchor, start = [], None, None
        for r in pdf.itertuples(index=False):
            if start is None or (r.timestamp - start).total_seconds() > seconds:
                anchor, start = r.id, r.timestamp
            out.append((r.id, anchor))
        return pd.DataFrame(out, columns=["id", "cluster"])

    return run


def time_clusters(ledger: DataFrame, seconds: float = 90) -> DataFrame:
    """(id, cluster): rows of one venue and day within `seconds` of the first row of their cluster. Not transitive, so each day is walked in order."""
    x = ledger.where("source is not null").select("id", "timestamp", "source", F.to_date("timestamp").alias("day"))
    return x.groupBy("source", "day").applyInPandas(_clusters(seconds), "id string, cluster string")


def summary(ledger: DataFrame, to_ccy: str = "GBP", rates: DataFrame | None = None) -> DataFrame:
    """Rewards by asset and UK tax year: events, quantity, value at receipt in the reporting currency."""
    x = with_rate(ledger.where("transaction_type = 'STAKING'"), to_ccy, rates)
    v = S.converted(F.col("fiat_value_at_trigger"), F.col("fx_rate"))
    return x.groupBy("asset", S.uk_tax_year(S.uk_day(F.col("timestamp"))).alias("tax_year")).agg(F.count("*").alias("n_events"), S.quantity(F.sum(S.units(F.col("amount")))).alias("quantity"), S.money(F.sum(v)).alias("value"), F.min("timestamp").alias("first_at"))
