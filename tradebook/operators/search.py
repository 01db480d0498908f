"""Predicates, projections, paging and access rules."""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import col, period_start
from tradebook.operators.postings import Postings, among, candidates

#: Rows that a top-k may hold for a page; bounds that one pass counts up to, and rows they are chosen from.
SHALLOW = 1_000
BOUNDS = 31
SAMPLE = 512

# The permissions a user can hold.
PERMISSIONS = (
    "clients", "products", "invoices", "deliveries", "statistics", "warehouse", "editUser",
)


def like_pattern(term: str) -> str:
    literal = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "\\%_" else m[1], term, flags=re.DOTALL)
    return f"%{literal}%"


def search_any(
    df: DataFrame, cols: Sequence[Column | str], term: str | None, index: Postings | None = None, key: str = "id"
) -> DataFrame:
    """Rows where any column contains ``term``, ignoring case; an empty term keeps every row.

    ``%`` and ``_`` in the term are wildcards. A backslash before any other character only means
    that character. With an ``index`` over the columns only the rows it names are looked at; the result is the same.
    """
    if not term:
        return df
    pattern = like_pattern(term)
    found = candidates(index, cols, pattern) if index is not None else None
    if found is not None:
        df = among(df, *found, key)
    return df.filter(functools.reduce(operator.or_, [col(c).ilike(pattern) for c in cols]))


def where_all(df: DataFrame, **equals: object) -> DataFrame:
    """AND of ``column = value`` over the values given; None means no predicate."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def between_dates(
    df: DataFrame,
    column: Column | str,
    start: dt.date | dt.datetime | None = None,
    end: dt.date | dt.datetime | None = None,
) -> DataFrame:
    """Inclusive range with optional ends."""
    if start is not None:
        df = df.filter(col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(col(column) <= F.lit(end))
    return df


def in_period(
    df: DataFrame, column: Column | str, period: str, as_of: dt.date | None = None
) -> DataFrame:
    """Rows since the start of the period holding ``as_of``; there is no upper bound."""
    return df.filter(col(column) >= period_start(period, as_of))


def active_only(df: DataFrame, enabled: bool = True) -> DataFrame:
    return df.filter(F.col("is_active")) if enabled else df


def non_blank(df: DataFrame, column: Column | str) -> DataFrame:
    return df.filter(col(column).isNotNull() & (col(column) != ""))


def by_ids(df: DataFrame, ids: Iterable | DataFrame | None, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids``: a short list, or a one-column DataFrame of any size."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        wanted = ids.toDF(key).distinct()
        return df.join(wanted, key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The requested keys that have no row."""
    return ids.toDF(key).distinct().join(df.select(key), key, "left_anti")


def relabel(df: DataFrame, labels: Mapping[str, Column | str]) -> DataFrame:
    """Projection to report labels, given as label -> column."""
    return df.select(*[col(c).alias(label) for label, c in labels.items()])


def check_page(page: int, limit: int, most: int = 100) -> None:
    if page < 1:
        raise ValueError("page must be a positive integer")
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")


@dataclass(frozen=True)
class Sort:
    """A column that rows are sorted by; rising ones have NULL last, falling ones NULL first."""

    column: Column
    falling: bool = False

    def order(self) -> Column:
        return self.column.desc_nulls_first() if self.falling else self.column.asc_nulls_last()

    def beyond(self, value: object) -> tuple[Column, Column]:
        """Whether a row comes after ``value``, and whether it is equal to it."""
        if value is None:
            return (self.column.isNotNull() if self.falling else F.lit(False)), self.column.isNull()
        given = F.lit(value)
        later = self.column < given if self.falling else (self.column > given) | self.column.isNull()
        return F.coalesce(later, F.lit(False)), F.coalesce(self.column == given, F.lit(False))


def sorted_by(df: DataFrame, order: Sequence[Sort]) -> DataFrame:
    return df.orderBy(*[s.order() for s in order])


def beyond(order: Sequence[Sort], values: Sequence[object]) -> Column:
    """Whether a row comes after the row that has ``values`` in the columns of ``order``."""
    after = F.lit(False)
    for sort, value in reversed(list(zip(order, values))):
        later, same = sort.beyond(value)
        after = later | (same & after)
    return after


def _bounds(df: DataFrame, order: Sequence[Sort]) -> list[tuple]:
    """Values of at most BOUNDS rows that cut ``df`` into parts of like size, in order.

    They come from the SAMPLE rows with the smallest hash: one narrow pass, a top-k of that many rows.
    """
    keys = [s.column.alias(f"_s{i}") for i, s in enumerate(order)]
    names = [f"_s{i}" for i in range(len(order))]
    some = df.select(*keys).orderBy(F.xxhash64(*names)).limit(SAMPLE)
    rows = [tuple(r) for r in sorted_by(some, [Sort(F.col(n), s.falling) for n, s in zip(names, order)]).collect()]
    step = max(1, len(rows) // (BOUNDS + 1))
    return rows[step::step][:BOUNDS]


def page_of(df: DataFrame, order: Sequence[Sort], page: int = 1, limit: int = 50, most: int = 100) -> DataFrame:
    """One page of the ordered rows. ``order`` must end in a unique key.

    Pages within the first SHALLOW rows are a top-k. For a later one, rows are counted up to each of a few sampled bounds,
    in a pass over the sort columns alone, and the search goes on between the two bounds around the page until few enough rows
    are left for a top-k. Nothing is written, and the number of passes grows with the logarithm of the list. For a walk through a
    whole list ``after`` of the list queries is cheaper.
    """
    check_page(page, limit, most)
    skip = (page - 1) * limit
    left = df
    while skip + limit > SHALLOW:
        bounds = _bounds(left, order)
        counts = left.agg(F.count(F.lit(1)), *[F.count_if(~beyond(order, b)) for b in bounds]).first()
        if skip >= counts[0]:
            return df.limit(0)
        low = max((i for i, n in enumerate(counts[1:]) if n <= skip), default=None)
        high = min((i for i, n in enumerate(counts[1:]) if n >= skip + limit), default=None)
        kept = (counts[0] if high is None else counts[1 + high]) - (0 if low is None else counts[1 + low])
        if kept >= counts[0]:  # rows that do not differ
            break
        if high is not None:
            left = left.filter(~beyond(order, bounds[high]))
        if low is not None:
            left, skip = left.filter(beyond(order, bounds[low])), skip - counts[1 + low]
    return sorted_by(left, order).offset(skip).limit(limit)


def after_key(
    df: DataFrame, column: str, value: object, key: str, last: object, descending: bool = False
) -> DataFrame:
    """Rows that follow (``value``, ``last``) by ``column``, then rising ``key``.

    Rising columns have NULL last, falling ones NULL first, as in the orders of the lists.
    """
    c, tie = F.col(column), F.col(key) > F.lit(last)
    if value is None:
        return df.filter((c.isNull() & tie) | (c.isNotNull() if descending else F.lit(False)))
    beyond = (c < F.lit(value)) if descending else (c > F.lit(value)) | c.isNull()
    return df.filter(beyond | ((c == F.lit(value)) & tie))


def page_info(df: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """The pagination envelope of the whole filtered frame, as one row."""
    check_page(page, limit)
    total = F.col("total")
    pages = F.ceil(total / F.lit(limit)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        total,
        pages.alias("totalPages"),
        (F.lit(page) < pages).alias("hasNext"),
        F.lit(page > 1).alias("hasPrev"),
    )


def top_k(df: DataFrame, measure: str, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` rows with the largest measure, ties in key order."""
    return df.orderBy(F.desc(measure), *[F.asc_nulls_last(c) for c in keys]).limit(k)


def newest_first(*extra: str) -> list[Sort]:
    return [Sort(F.col("created_at"), falling=True), *[Sort(F.col(c)) for c in extra or ("id",)]]


def visible_logs(
    logs: DataFrame, viewer_id: object, viewer_role: str, user_id: object | None = None
) -> DataFrame:
    """Log rows one viewer may see: an admin everything or one chosen user, others their own."""
    return where_all(logs, user_id=user_id if viewer_role == "admin" else viewer_id)


def visible_log_counts(logs: DataFrame, users: DataFrame) -> DataFrame:
    """For every viewer, how many log rows the rule of ``visible_logs`` lets them see."""
    own = logs.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("own"))
    total = logs.agg(F.count(F.lit(1)).alias("n")).scalar()
    seen = F.when(F.col("role") == "admin", total).otherwise(F.coalesce("own", F.lit(0)))
    return users.join(own, "id", "left").select("id", "username", "role", seen.alias("visible"))


def _held(name: Column) -> Column:
    flags = F.from_json("permissions", "map<string,string>")
    value = F.try_element_at(flags, name)
    truthy = value.isNotNull() & ~value.isin("", "0", "false", "null")
    return F.col("is_active") & ((F.col("role") == "admin") | F.coalesce(truthy, F.lit(False)))


def granted(users: DataFrame, permission: str) -> DataFrame:
    """Active users holding a permission; an admin holds every one."""
    return users.filter(_held(F.lit(permission)))


def granted_all(users: DataFrame) -> DataFrame:
    """One row per user and permission held."""
    every = users.withColumn("permission", F.explode(F.array(*map(F.lit, PERMISSIONS))))
    return every.filter(_held(F.col("permission")))
