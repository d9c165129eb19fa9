"""When two rows are the same event: by id, by content, by on-chain leg. Only rows whose key another row has are dealt by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.spread import LOOKUP_ROWS

# Sources whose trade group is the transaction's id.
CHAINS = ("solana", "ethereum", "bitcoin", "cardano", "celestia")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)


def _amount() -> Column:
    return F.coalesce(F.round("amount", 8), F.lit(0.0)) + F.lit(0.0)  # -0.0 is 0.0


def content_key() -> Column:
    """The event as its row tells it, to 8 places and to the cent."""
    group = F.coalesce(F.nullif("on_chain_tx_id", F.lit("")), F.nullif("trade_group_id", F.lit("")), F.lit(""))
    value = F.coalesce(F.round("fiat_value_at_trigger", 2), F.lit(0.0)) + F.lit(0.0)
    return _key(_text("source"), group, _text("transaction_type"), _text("asset"), _amount(), _text("transfer_direction"), F.coalesce("instrument_kind", F.lit("spot")), value, F.unix_micros("timestamp"))


def chain_key() -> Column:
    """The leg of a transaction, whatever its value and time; null for rows without a transaction."""
    chain = F.coalesce(F.nullif("on_chain_tx_id", F.lit("")), F.when(F.col("source").isin(*CHAINS), F.nullif("trade_group_id", F.lit(""))))
    return F.when(chain.isNotNull(), _key(chain, _text("transaction_type"), _text("asset"), _amount(), _text("transfer_direction"), F.coalesce("instrument_kind", F.lit("spot"))))


def _short(key: Column) -> Column:
    """A key as it is dealt: 16 bytes."""
    return F.unhex(F.md5(key))


def _first_of(ledger: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Of the rows of one key the one with an on-chain id, then the higher value, the earlier time, the earlier place."""
    has = F.coalesce(F.length("on_chain_tx_id") > 0, F.lit(False))
    order = F.struct(F.when(has, 0).otherwise(1), -F.coalesce("fiat_value_at_trigger", F.lit(0.0)), F.coalesce(F.unix_micros("timestamp"), F.lit(0)), F.coalesce("seq", F.lit(0)), _text("id"))
    return ledger.groupBy(_short(key).alias("_k")).agg(F.min_by(F.struct(*columns), order).alias("_r")).select("_r.*")


def _staged(ledger: DataFrame) -> DataFrame:
    cols = ledger.columns
    x = _first_of(ledger, F.coalesce("id", content_key()), cols)
    x = _first_of(x, content_key(), cols)
    # Rows of no transaction keep to themselves, by their content, which is theirs alone by now.
    return _first_of(x, F.coalesce(chain_key(), F.concat(F.lit("-"), content_key())), cols)


def _hashes() -> list[Column]:
    """Of each key a number; rows of one key have one, others hardly ever."""
    return [F.xxhash64(F.lit("i"), F.coalesce("id", content_key())), F.xxhash64(F.lit("c"), content_key()), F.when(chain_key().isNotNull(), F.xxhash64(F.lit("l"), chain_key()))]


def deduplicated(ledger: DataFrame) -> DataFrame:
    """The ledger with one row an id, then a content, then an on-chain leg. Rows without an id are told by their content.

    Numbers of the keys are counted first. A row whose numbers are its own has no copy and stays where it lies; if there are few others, only they
    are dealt, else all are. `ledger` is read several times: cut it if it is dear.
    """
    shared = cut(ledger.select(F.explode(F.array_compact(F.array(*_hashes()))).alias("_h")).groupBy("_h").count().where("count > 1").select("_h"))
    n = shared.limit(LOOKUP_ROWS + 1).count()
    if n == 0:
        return ledger
    if n > LOOKUP_ROWS:
        return _staged(ledger)
    x = ledger.withColumns({f"_h{i}": h for i, h in enumerate(_hashes())})
    for i in range(3):
        x = x.join(F.broadcast(shared.select(F.col("_h").alias(f"_h{i}"), F.lit(True).alias(f"_s{i}"))), f"_h{i}", "left")
    copied = F.coalesce("_s0", "_s1", "_s2").isNotNull()
    return x.where(~copied).select(*ledger.columns).unionByName(_staged(x.where(copied).select(*ledger.columns)))


def _known(rows: DataFrame) -> Column:
    return F.array_compact(F.array(_short(F.concat(F.lit("i"), F.col("id"))), _short(F.concat(F.lit("c"), content_key())), _short(F.concat(F.lit("l"), chain_key()))))


def novel_rows(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of a batch of which neither id, nor content, nor on-chain leg is in the ledger."""
    x = batch.withColumn("_row", _short(F.coalesce("id", content_key())))
    keys = x.select("_row", F.explode(_known(x)).alias("_key"))
    present = ledger.select(F.explode(_known(ledger)).alias("_key"))
    return x.join(keys.join(present, "_key", "left_semi").select("_row"), "_row", "left_anti").select(*batch.columns)
