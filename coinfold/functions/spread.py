"""Group aggregates and running sums that no single task has to hold, whatever the largest group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: A group with more than this part of all rows is hot; there are fewer such groups than that, which bounds their broadcast.
HOT_GROUPS = 10_000


def give(df: DataFrame, per_group: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """`df` joined with `per_group`, which has one row for each group, and in `n` (left out then) how many rows of `df` the group has.

    Rows of hot groups, fewer than `HOT_GROUPS` if `total` is at least the number of rows, get a broadcast where they lie; only rows of other
    groups are dealt by key. So a group with a third of all rows meets in no task. Rows without a group are left out. Both
    tables are read several times: cut them if they are dear.
    """
    limit = max(1, total // HOT_GROUPS)
    fields = [c for c in per_group.columns if c not in (*keys, n)]
    groups = per_group.select(*keys, n, F.struct(F.lit(True).alias("__there"), *fields).alias("__group"))
    # One broadcast serves both branches: it holds what the hot groups give, or nothing.
    x = df.join(F.broadcast(groups.where(F.col(n) > limit).drop(n)), keys, "left")
    there = x.where("__group is not null")
    moved = x.where("__group is null").drop("__group").join(groups.where(F.col(n) <= limit).drop(n), keys)
    return there.unionByName(moved).select(*df.columns, *[f"__group.{c}" for c in fields])


def attach(df: DataFrame, keys: list[str], total: int | None = None, **aggs: Column) -> DataFrame:
    """`df` with aggregates of each row's group as further columns; rows with a null key are left out.

    Aggregates are combined before they move and come back by `give`. `total`: at least the number of rows, counted if not given. `df` is
    read several times: cut it if it is dear.
    """
    g = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("__n"), *[c.alias(n) for n, c in aggs.items()])
    return give(df, g, keys, "__n", df.count() if total is None else total)


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """`df` with, for each name, the sum of its column over all rows before this one in `order` (0 for the first).

    Rows are dealt by ranges of the order; each range starts from the totals of the ranges before it, which are as many rows as there are
    partitions. `order` must be total, or rows that tie get their sums in any order.
    """
    x = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = x.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(base), "__part")
    return x.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("__part", *[f"__{n}" for n in sums])


#: A table of at most so many rows is a lookup that every task can hold.
LOOKUP_ROWS = 200_000


def look_up(df: DataFrame, lookup: DataFrame, on: Column | str | list[str], how: str = "left") -> DataFrame:
    """`df` joined with a table of one row a key: by a broadcast if the table's counted rows are few, else dealt by key, where Spark splits
    hot keys at run time. `lookup` is read twice: cut it if it is dear."""
    few = lookup.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return df.join(F.broadcast(lookup) if few else lookup, on, how)


def carried(df: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """`df` with, as `name`, the last value that isn't null of the rows of the same key up to this one in `order`; null if there is none.

    Rows are dealt by ranges of key and order, so a key with a third of all rows is spread over many tasks. A range starts with what its first
    key had in the ranges before, one value at most for each range: that bounds the broadcast. Rows with a null key get null.
    """
    x = cut(df.where(F.col(key).isNotNull()).withColumn("__v", F.struct(value.alias("v"))).repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__in", F.last(F.when(F.col("__v.v").isNotNull(), F.col("__v")), True).over(inside))
    # Of each range and key what it ends with; a key that lies in several ranges has few such rows.
    last = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = x.withColumn("__end", F.last("__in", True).over(last)).groupBy("__part", key).agg(F.first("__end", True).alias("__end"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("__base", F.last("__end", True).over(before)).where("__base is not null").select("__part", key, "__base")
    x = x.join(F.broadcast(base), ["__part", key], "left").withColumn(name, F.coalesce("__in", "__base")["v"])
    return x.select(*df.columns, name).unionByName(df.where(F.col(key).isNull()).withColumn(name, F.lit(None).cast(x.schema[name].dataType)))
