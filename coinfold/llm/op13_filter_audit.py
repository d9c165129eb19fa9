"""How filters interact: each document is replayed through every order of the filters.

A document has one flag for each filter it fails. Documents are crossed with the orders of the filters, a broadcast of k! rows
(120 for five filters, a bound that no input moves), and each pair is exploded into its steps. The first failure in the order says
where the document is removed; what happens at each step is a sum of conditions, combined in the tasks before it moves, so
a shuffle carries at most one row for each part, order and step from a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, stored, table

LETTERS = "ABCDE"
MOST_FILTERS = 6
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D of a text and its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def mask(failures: list[Column]) -> Column:
    """Failures as bits of one number, the first filter in the lowest."""
    out = F.lit(0)
    for i, f in enumerate(failures):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic): one row per row of `docs`; `fails` has the bits of filters A to E.

    Null texts are empty, null sources the empty string. E compares texts by SHA-256 over the whole table: a row fails it if the
    same text stands under a smaller id. Rows with a null id never fail E, aren't an earlier text, and have no label; rows of the same id and
    text don't make each other fail. Of repeated labels any that is 1 counts. Other columns are ignored whatever their names.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    narrow = stored(src.select("id", "part", mask(text_failures(F.col("text"), F.col("words"))).alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    first = attach(narrow, ["digest"], first=F.min("id"))
    first = first.select("id", "part", (F.col("fails") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)).alias("fails"))
    there = first.where("id is not null").join(known, "id", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return there.unionByName(first.where("id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(ord, filter_order, bit_1 .. bit_k): every order of the filters, with the bit of the filter at each step."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"from 1 to {MOST_FILTERS} different filters")
    rows = [(i, "".join(p), *(1 << letters.index(c) for c in p)) for i, p in enumerate(permutations(letters))]
    return spark.createDataFrame(rows, "ord int, filter_order string, " + ", ".join(f"bit_{i} int" for i in range(1, len(letters) + 1)))


def replay(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, fails, good, toxic).

    One row for each part, order and step, zeros included. Bit i of `fails` belongs to letter i; bits beyond the letters are ignored, a null
    counts as no failure. An empty table gives no rows; a null part is a part of its own.
    """
    k = len(letters)
    o = orders(flags.sparkSession, letters)
    bits = [F.col(f"bit_{i}") for i in range(1, k + 1)]
    fails = F.coalesce(F.col("fails"), F.lit(0)).bitwiseAND((1 << k) - 1)
    x = flags.select("part", fails.cast("int").alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    x = x.withColumn("only", F.bit_count("fails") == 1).crossJoin(F.broadcast(o.drop("filter_order")))
    first = F.lit(k + 1)
    for i in range(k, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(bits[i - 1]) != 0, i).otherwise(first)
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), b.alias("bit")) for i, b in enumerate(bits)])).alias("at")
    x = x.select("part", "ord", "fails", "good", "toxic", "only", first.alias("first"), steps)
    step, hit, gone = F.col("at.step"), F.col("fails").bitwiseAND(F.col("at.bit")) != 0, F.col("first") == F.col("at.step")
    sums = {"kept": F.col("first") > step, "removed": gone, "redundant": hit & (F.col("first") < step), "unique_fails": hit & F.col("only"), "good_lost": gone & F.col("good"), "toxic_lost": gone & F.col("toxic")}
    g = x.groupBy("part", "ord", step.alias("step")).agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in sums.items()])
    g = g.join(F.broadcast(o.select("ord", "filter_order")), "ord").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # A window holds k! rows of counts, whatever the documents.
    whole = g.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return whole.select("part", "filter_order", "step", *sums, "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS x
  FROM w LEFT JOIN labels USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (
  SELECT part, good, toxic, filter_order, [CASE s WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END FOR s IN string_split(filter_order, '')] AS fails FROM f, o),
p AS (SELECT *, coalesce(nullif(list_position(fails, true), 0), 6) AS first, len(list_filter(fails, lambda v: v)) AS n FROM r),
s AS (SELECT *, unnest([1, 2, 3, 4, 5])::int AS step FROM p),
g AS (
  SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (fails[step] AND first < step) AS redundant,
    count(*) FILTER (fails[step] AND n = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::bigint AS shapley FROM g
"""
