"""Pool shares: which lots are open, and sales of shares that an import left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..functions.spread import attach, running


def _shares(ledger: DataFrame, share_mints: tuple[str, ...]) -> DataFrame:
    made = F.startswith(F.upper("asset"), F.lit("LP:"))
    share = made | F.coalesce("token_mint", "asset").isin(*share_mints) if share_mints else made
    return ledger.withColumn("_share", F.coalesce(share, F.lit(False)))


def open_shares(ledger: DataFrame, share_mints: tuple[str, ...] = ()) -> DataFrame:
    """(id, asset, timestamp, rest): pool shares bought that sales of the same share haven't used up, first in, first out; rest in units.

    A lot lies on its asset's axis of quantity, and what was sold in all covers that axis from its begin. The sums run over ranges of the
    whole order, so no task holds an asset.
    """
    x = _shares(ledger, share_mints).where("_share and amount > 0")
    buy = (F.col("transaction_type") == "BUY") & (F.col("event_subtype") == "lp_add")
    sale = (F.col("transaction_type") == "SELL") & (F.col("event_subtype") == "lp_remove")
    u = S.units(F.col("amount"))
    rows = x.where(buy | sale).select("id", "asset", "timestamp", F.when(buy, u).otherwise(0).alias("got"), F.when(sale, u).otherwise(0).alias("sold"))
    at = cut(running(rows, [F.col("asset"), F.col("timestamp"), F.col("id")], before=F.col("got")))
    at = attach(at, ["asset"], base=F.min("before"), used=F.sum("sold"))
    rest = F.greatest(F.lit(0), F.least(F.col("got"), F.col("before") - F.col("base") + F.col("got") - F.col("used")))
    return at.withColumn("rest", rest).where("rest > 0").select("id", "asset", "timestamp", "rest")


def inferred_burns(ledger: DataFrame, share_mints: tuple[str, ...] = ()) -> DataFrame:
    """The ledger of `liquidity_for_tax` with the sales of `missing_burns`. A second pass adds nothing."""
    return ledger.unionByName(missing_burns(ledger, share_mints), allowMissingColumns=True)


#: What of a ledger's rows the burns are inferred from.
READ = ("id", "asset", "timestamp", "transaction_type", "event_subtype", "amount", "fiat_value_at_trigger", "fiat_currency", "source", "trade_group_id", "token_mint")


def missing_burns(ledger: DataFrame, share_mints: tuple[str, ...] = ()) -> DataFrame:
    """A sale of a pool share for each group of the ledger that took assets out of a pool without a share leg.

    Each such group, in order of time, closes the oldest open lot whole, also one that is later than the group. So the k-th group meets the
    k-th open lot, and both ranks are joined. Groups beyond the last lot get no sale. The sale is worth what came out, and its note says
    if several lots were open. Its group then has a share leg. The ledger is read once; its pool rows are kept as a table meanwhile.
    """
    ledger = cut(ledger.where("event_subtype in ('lp_add', 'lp_remove')").select(*[c for c in READ if c in ledger.columns]))
    lots = cut(open_shares(ledger, share_mints))
    lots = attach(lots, ["asset"], last=F.max(F.struct("timestamp", "id")))
    lots = cut(running(lots.withColumn("final", (F.struct("timestamp", "id") == F.col("last")).cast("int")), [F.col("timestamp"), F.col("id")], rank=F.lit(1), ended=F.col("final")))
    n, assets = lots.agg(F.count("*"), F.coalesce(F.sum("final"), F.lit(0))).first()
    taken = (F.col("transaction_type") == "BUY") & ~F.col("_share")
    first = F.struct("timestamp", "id")
    groups = (
        _shares(ledger, share_mints).where("event_subtype = 'lp_remove' and trade_group_id is not null").groupBy("trade_group_id")
        .agg(
            F.min(F.when(taken, F.col("timestamp"))).alias("at"), F.sum(F.when(taken, F.greatest(S.cents(F.coalesce("fiat_value_at_trigger", F.lit(0.0))), F.lit(0)))).alias("out_c"),
            F.min_by("source", F.when(taken, first)).alias("venue"), F.min_by("fiat_currency", F.when(taken & F.col("fiat_currency").isNotNull(), first)).alias("currency"),
            F.max(F.col("_share") & (F.col("transaction_type") == "SELL")).alias("burned"),
        ).where("at is not null and not burned")
    )
    groups = running(groups, [F.col("at"), F.col("trade_group_id")], rank=F.lit(1))
    left = F.lit(n) - F.col("rank")
    across = F.lit(assets) - F.col("ended")
    note = F.concat(F.lit("The burn of a pool share is missing: closes the oldest open one, "), F.col("asset"), F.lit("."))
    more = F.when(left > 1, F.format_string(" %d shares of %d assets were open, please verify.", left.cast("long"), across.cast("long"))).otherwise("")
    gid = F.col("trade_group_id")
    return groups.join(lots.select("rank", "asset", "rest", "ended"), "rank").select(
        F.concat(F.lit("lp-dispose-"), gid).alias("id"), F.col("at").alias("timestamp"), "asset", F.lit("SELL").alias("transaction_type"), S.quantity(F.col("rest")).alias("amount"), S.money(F.col("out_c")).alias("fiat_value_at_trigger"),
        F.lit(0.0).alias("fee_fiat"), F.when(F.col("out_c") > 0, F.col("currency")).alias("fiat_currency"), F.coalesce("venue", F.lit("amm_lp")).alias("source"), gid.alias("trade_group_id"), gid.alias("on_chain_tx_id"),
        F.lit("lp_remove").alias("event_subtype"), F.concat(note, more).alias("normalization_note"),
    )
