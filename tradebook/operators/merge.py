"""Insert-or-update, insert-or-ignore and first-come rules over whole batches."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.operators.bloom import narrowed
from tradebook.operators.claims import clashes


def one_per_key(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``.

    An aggregate, not a window: partial results are combined before the shuffle, so a key that owns
    a large part of the batch costs one row per task.
    """
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*df.columns), order).alias("_row"))
    return best.select("_row.*")


def upsert(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    set_cols: Sequence[str],
    order: str | None = None,
) -> DataFrame:
    """Insert rows whose key is new; on a known key replace ``set_cols`` and keep the rest.

    With ``order`` the last update of a key counts.
    """
    if order is not None:
        updates = one_per_key(updates, keys, order, last=True)
    old = base.withColumn("_old", F.lit(True)).alias("o")
    new = updates.withColumn("_new", F.lit(True)).alias("n")
    on = functools.reduce(operator.and_, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    known, given = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()

    def pick(c: str):
        if c not in updates.columns:
            return F.col(f"o.{c}").alias(c)
        use_new = given if c in set_cols else given & ~known
        return F.when(use_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return old.join(new, on, "full").select(*[pick(c) for c in base.columns])


def insert_ignore(
    base: DataFrame, rows: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Add rows whose key is new; inside the batch the first row of a key wins."""
    fresh = one_per_key(rows, keys, order).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh.select(*[c for c in rows.columns if c in base.columns]),
                            allowMissingColumns=True)


def taken(requests: DataFrame, base: DataFrame, keys: Sequence[str], own: str | None = None) -> DataFrame:
    """Ids of requests one of whose keys already exists in ``base``; NULL never collides.

    One equi-join per key, then a union: a single join on ``a = x OR b = y`` would compare every
    pair. Of a large ``base`` only rows that the keys of a small batch may meet are shuffled. With ``own`` the row
    named by the request itself does not count.
    """
    hits = []
    for key in keys:
        left = requests.select("request_id", F.col(key).alias("_k"), *([own] if own else []))
        right = narrowed(
            base.select(F.col(key).alias("_k"), F.col("id").alias("_holder")).filter("_k IS NOT NULL"), "_k", left.select("_k"))
        if own:
            found = left.join(right, "_k").filter(F.col(own) != F.col("_holder"))
        else:
            found = left.join(right, "_k", "left_semi")
        hits.append(found.select("request_id"))
    return functools.reduce(DataFrame.unionByName, hits).distinct()


def first_come(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids of the requests that get through when taken one by one in ``request_id`` order.

    A request passes unless an earlier one that passed holds one of its keys. With one key that is
    the first request of each key. With several, a request beaten on one key frees its other keys:
    every request claims its keys for a row of its own.
    """
    if len(keys) == 1:
        key = keys[0]
        first = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("request_id").alias("request_id"))
        return first.select("request_id").unionByName(requests.filter(F.col(key).isNull()).select("request_id"))
    slim = requests.select("request_id", *keys)
    own = slim.withColumn("id", F.col("request_id").cast("string"))
    return slim.select("request_id").join(clashes(own, None, keys), "request_id", "left_anti")
