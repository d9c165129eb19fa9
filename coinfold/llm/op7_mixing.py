"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each document draws the exponential key -ln(u) / w from a hash of its id and its quality weight w. Within a source, documents
are ordered by key and their sizes summed along that order; what the target asks for beyond complete epochs is taken from the
front. A source of any size is worked on in slices of its key order, cut at the keys' own quantiles, so that they are even
whatever the weights: slice totals are summed first, then each slice adds its own offset, so no task ever holds a whole
source. Sources themselves are ranked and summed in ranges, so they may be many as well.

Python stays off this path, so the default weight is a share of symbols counted by SQL functions; a learned quality score, as op4 gives,
is passed in as the column `quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give, running, stored, table, unused

SLICE = 1024
CUTS = 64


def text_size(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of characters that aren't digits or symbols."""
    rest = F.length(F.translate(text, "0123456789#$%&*|<>{}[]()=+_/\\!@^~`\"", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.try_divide(rest, F.length(text))), F.lit(0.05))


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): budgets by weight, none above `cap` times its size.

    Sources take the weights in turn by code point, null last. The excess of capped sources is reshared by weight until none is
    above: in order of size per weight, ties by name, the first source that stays below its cap when exactly those before
    it are capped gives the level, what a unit of weight gets.
    """
    name = [F.col("source").isNull(), F.col("source")]
    s = running(sources.select("source", "source_size"), name, position=F.lit(1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("position", F.lit(len(weights))) + 1).cast("int"))
    s = cut(s.withColumn("w", w).select("source", "source_size", "w", (F.col("source_size") * float(cap)).alias("most")))
    total = s.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    if not total["w"]:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    r = running(s, [F.col("most") / F.col("w"), *name], full=F.col("most"), gone=F.col("w"))
    level = (F.lit(total["size"] * float(share)) - F.col("full")) / (F.lit(total["w"]) - F.col("gone"))
    first = r.where(level * F.col("w") <= F.col("most")).agg(F.min(F.struct(F.col("most") / F.col("w"), *name, level.alias("level")))["level"]).first()[0]
    target = F.col("most") if first is None else F.least(F.col("most"), F.lit(first) * F.col("w"))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def _slice(key: Column, n: Column, cuts: Column) -> Column:
    """Which slice of its source a key is in: a segment between quantiles, and an even part of that segment.

    Keys of the last segment have no end; the gap before it tells how fast they thin out.
    """
    parts = F.ceil(n / (CUTS * SLICE))
    i = F.size(F.filter(cuts, lambda c: c <= key))
    lo = F.when(i == 0, 0.0).otherwise(F.element_at(cuts, F.greatest(i, F.lit(1))))
    hi = F.element_at(cuts, F.least(i + 1, F.lit(CUTS - 1)))
    gap = F.element_at(cuts, CUTS - 1) - F.element_at(cuts, CUTS - 2)
    inside = F.when(i < CUTS - 1, F.try_divide(key - lo, hi - lo)).otherwise(1 - F.exp(-F.try_divide((key - lo) * F.log(F.lit(2.0)), gap)))
    part = F.least(F.floor(F.coalesce(inside, F.lit(0.0)) * parts), parts - 1)
    return (i * parts + part).cast("long")


def _mix(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int, id_col: str, text_col: str, source_col: str, quality: Column | None, row_col: str | None = None) -> DataFrame:
    """The plan of `mix_sources`, with `row` if the rows have a key of their own, which then settles the order of equal ids."""
    text = F.col(f"`{text_col}`")
    row = [F.xxhash64(text).alias("tie"), F.col(row_col).alias("row")] if row_col else []
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`")), F.lit("")).alias("of"), text_size(text).alias("size"),
        (quality if quality is not None else text_quality(text)).cast("double").alias("quality"),
        # Rows without an id draw by their text, so that they don't share one key.
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).alias("who"), *row,
    )
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "who", F.coalesce("source", F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") + 1) / float((1 << 52) + 1)
    base = cut(base.withColumn("key", -F.log(u) / F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(1e-6))).drop("who", "quality"))
    fractions = [i / CUTS for i in range(1, CUTS)]
    sums = cut(base.groupBy("of", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.percentile_approx("key", fractions, 2000).alias("cuts")))
    targets = source_targets(sums, weights, share, cap).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"), "target")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sums.drop("source").join(targets, "of").withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    plan = cut(plan.withColumn("rows", F.col("n")))
    base = give(base, plan, ["of"], "n", base.count()).withColumn("slice", _slice(F.col("key"), F.col("rows"), F.col("cuts"))).drop("rows", "cuts")
    totals = base.groupBy("of", "slice").agg(F.sum("size").alias("sum"))
    # A source's offsets are a row for each slice of about a thousand documents.
    before = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = base.join(totals.select("of", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")), ["of", "slice"])
    inside = Window.partitionBy("of", "slice").orderBy("key", "doc_id", "size", *(["tie", "row"] if row else [])).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # The document at which the budget ends is taken if more than half of it is inside.
    picked = (F.col("size") > 0) & (start + F.col("size") / 2 <= F.col("rest"))
    return base.withColumn("epochs", (F.col("full") + F.when(picked, 1).otherwise(0)).cast("int"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, epochs, taken): one row per row of `docs`.

    Sources take the weights in turn, by code point, null last. taken = size * epochs; epochs counts the complete passes
    over the source plus one if the fractional pass picks the document. Null and empty texts have size 0 and are picked only by
    complete passes; a null quality counts as the least. Repeated ids of a source draw the same key, rows without an id one from their text;
    their order among themselves does not change any sum by more than one document. An empty table gives no rows. Other columns are ignored
    whatever their names. The same rows and seed always give the same result.
    """
    base = _mix(docs, weights, share, cap, seed, id_col, text_col, source_col, quality)
    return base.select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def mixed_rows(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None,
) -> DataFrame:
    """The mix itself: each row of `docs` as often as its own plan takes it, with the columns of `docs`; ids may be null or repeat.

    Rows get a key that is written with them, so that the plan and the rows meet one to one. A row of size 0 comes as often as complete
    passes over its source; an empty table gives an empty one.
    """
    row, key, epochs = (unused(docs, c) for c in ("row_of_mix", "key_of_mix", "epochs_of_mix"))
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    mix = _mix(keyed, weights, share, cap, seed, id_col, text_col, source_col, quality, row).where("epochs > 0")
    taken = keyed.join(mix.select(F.col("row").alias(key), F.col("epochs").alias(epochs)), F.col(row) == F.col(key))
    return taken.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(epochs)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
    coalesce(greatest(0.05::double, length(translate(text, '0123456789#$%&*|<>{}[]()=+_/\!@^~`"', ''))::double / nullif(length(text), 0)), 0.05::double) AS q,
    md5('11|' || doc_id || '|' || coalesce(source, '')) AS h FROM documents),
k AS (SELECT *, -ln((('0x' || substr(h, 1, 13))::bigint + 1) / 4503599627370497.0::double) / q AS key FROM d),
s AS (
  SELECT *, 2.0::double * source_size AS most, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::int % 3 + 1] AS w
  FROM (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1)),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level,
    row_number() OVER (ORDER BY most / w, source NULLS LAST) AS r FROM s WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::double ELSE least(most, w * (SELECT arg_min(level, r) FROM l WHERE level * w <= most)) END AS target FROM s),
p AS (
  SELECT k.*, source_size, target, floor(target / nullif(source_size, 0)) AS passes,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * (coalesce(passes, 0) + CASE WHEN size > 0 AND ahead + size / 2.0 <= target - passes * source_size THEN 1 ELSE 0 END))::bigint AS taken FROM p
"""
