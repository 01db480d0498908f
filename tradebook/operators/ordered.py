"""Ordered computations inside a key that hold when one key owns most of the rows.

A plain window puts all rows of a key into one task. Here the rows are range-partitioned by
(keys, order), so a large key is spread over many slices; the slices are pinned in the shared
folder, each slice is computed on its own, and one small row per (key, slice) carries what the next
slice needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook.session import pinned

SLICE = "_slice"


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by (keys, order) and pin the rows with their slice number.

    ``order`` must be unique inside a key, otherwise equal rows stay together in one slice.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return pinned(ranged.withColumn(SLICE, F.spark_partition_id()))


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def _before(summary: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of ``value`` over the earlier slices of the key."""
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, SLICE, F.sum(value).over(earlier).alias("_before"))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including the row, in order, per key."""
    cut = slices(df, keys, order)
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*keys, SLICE).agg(F.sum(value).alias("_total"))
    local = cut.withColumn("_local", F.sum(value).over(inside))
    joined = local.join(_before(totals, keys, "_total"), [*keys, SLICE])
    whole = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0).cast("decimal(38,2)"))
    return joined.withColumn(out, whole).drop(SLICE, "_local", "_before")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 1, 2, 3, ... in order, per key."""
    cut = slices(df, keys, order)
    counts = cut.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_total"))
    local = cut.withColumn("_local", F.row_number().over(_inside(keys, order)))
    joined = local.join(_before(counts, keys, "_total"), [*keys, SLICE])
    whole = F.col("_local").cast("long") + F.coalesce(F.col("_before"), F.lit(0))
    return joined.withColumn(out, whole).drop(SLICE, "_local", "_before")


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the non-NULL ``value`` of the preceding row of the key, NULL on the first."""
    cut = slices(df, keys, order)
    last = cut.groupBy(*keys, SLICE).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    handed = last.select(*keys, SLICE, F.lag("_last").over(_across(keys)).alias("_before"))
    local = cut.withColumn("_local", F.lag(value).over(_inside(keys, order)))
    joined = local.join(handed, [*keys, SLICE])
    return joined.withColumn(out, F.coalesce("_local", "_before")).drop(SLICE, "_local", "_before")


def nest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[Column],
    out: str,
    chunk: int = 10_000,
    counted: DataFrame | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key with an ordered array of structs, at most ``chunk`` elements per row.

    A key with more elements continues in rows with part 2, 3, ..., so no row holds an unbounded array and no element is
    lost. ``part`` belongs to the key of the result. Rows with a NULL in a key have no list.

    Rows are counted first. Those of keys with at most ``chunk`` of them, as a rule all, go through one shuffle; those of
    larger keys are spread over slices and numbered there. ``counted``: rows to count in place of ``df``, when these are
    cheaper to get and about as many per key; they only choose the way, the lists are the same. ``by``: the keys to
    shuffle by, fewer when a join on these follows; none when a join by the keys left the rows together already.
    """
    df = df.dropna(subset=list(keys))
    large = pinned((df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > chunk).select(*keys))
    none = large.isEmpty()
    rest = df if none else df.join(large, list(keys), "left_anti")
    by = keys if by is None else by
    lists = _whole(rest.repartition(*by) if by else rest, keys, order, fields, out, chunk)
    return lists if none else lists.unionByName(_parts(df.join(large, list(keys), "left_semi"), keys, order, fields, out, chunk))


def _sorted_list(order: Sequence[str], fields: Sequence[Column]) -> Column:
    element = F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("_value"))
    return F.array_sort(F.collect_list(element))


def _whole(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[Column], out: str, chunk: int
) -> DataFrame:
    """Lists made at once and cut into parts."""
    lists = df.groupBy(*keys).agg(_sorted_list(order, fields).alias("_all"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.size("_all") / F.lit(chunk)).cast("int"))))
    cut = F.slice("_all", (F.col("part") - 1) * chunk + 1, F.lit(chunk))
    return lists.select(*keys, "part", F.transform(cut, lambda e: e["_value"]).alias(out))


def _parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[Column], out: str, chunk: int
) -> DataFrame:
    """Lists made part by part, which follow from the positions inside the keys: no task holds the rows of a key."""
    numbered = positions(df, keys, order, "_position")
    numbered = numbered.withColumn("part", F.ceil(F.col("_position") / F.lit(chunk)).cast("int"))
    lists = numbered.groupBy(*keys, "part").agg(_sorted_list(order, fields).alias("_all"))
    return lists.select(*keys, "part", F.transform("_all", lambda e: e["_value"]).alias(out))
