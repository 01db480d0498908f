"""What a batch of change requests shares: verdicts, patches, inserts, activity rows.

A batch gives the result of taking its requests one by one in ``request_id`` order, except where a
docstring says otherwise. Every operator is a set of joins and aggregates over the whole batch and
returns the new state of the tables it touches; nothing is written in place.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import clean_ip, time_stamp
from tradebook.session import pinned
from tradebook.sources.model import TOUCHED, apply_defaults, derived_id, ensure_columns

Tables = Mapping[str, DataFrame]
Ids = Callable[[str], Column]


@dataclass(frozen=True)
class Change:
    """Outcome of a batch.

    ``tables``: new state of each touched table. ``rows``: only the inserted or altered rows, for
    sinks that can append or merge. ``gone``: keys of removed rows. ``rejected``: request_id and
    reason. ``activity``: log rows of the accepted requests.
    """

    tables: dict[str, DataFrame]
    rejected: DataFrame
    activity: DataFrame
    rows: dict[str, DataFrame] = field(default_factory=dict)
    gone: dict[str, DataFrame] = field(default_factory=dict)


def string_ids(table: str) -> Column:
    """Id of a new row, derived from its request (and line), so re-run tasks agree on it."""
    parts = [F.col("request_id").cast("string")]
    if table in ("invoice_items", "delivery_items"):
        parts.append(F.col("line_no").cast("string"))
    return derived_id(table, *parts)


def rejections(*checks: tuple[str, DataFrame]) -> DataFrame:
    """One reason per refused request: the earliest check that names it.

    Pinned, because the accepted rows, the rejected rows and the log all depend on it.
    """
    ranked = [
        ids.select("request_id", F.struct(F.lit(i).alias("rank"), F.lit(reason).alias("reason")).alias("_r"))
        for i, (reason, ids) in enumerate(checks)
    ]
    worst = functools.reduce(DataFrame.unionByName, ranked).groupBy("request_id").agg(F.min("_r").alias("_r"))
    return pinned(worst.select("request_id", F.col("_r.reason").alias("reason")))


def without(requests: DataFrame, rejected: DataFrame) -> DataFrame:
    return requests.join(rejected.select("request_id"), "request_id", "left_anti")


def also(rejected: DataFrame, requests: DataFrame, passed: DataFrame, reason: str) -> DataFrame:
    """Add the requests that are neither rejected nor in ``passed``."""
    rest = without(without(requests, rejected), passed).select("request_id", F.lit(reason).alias("reason"))
    return pinned(rejected.unionByName(rest))


def invalid(violations: DataFrame) -> DataFrame:
    """Ids of requests with at least one violation."""
    return violations.select("request_id").distinct()


def out_of_range(requests: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Ids of requests with a value that its column's type can't take; absent columns don't count."""
    bad = [F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull() for c, kind in kinds.items() if c in requests.columns]
    return requests.filter(functools.reduce(operator.or_, bad, F.lit(False))).select("request_id")


def not_in(requests: DataFrame, base: DataFrame, column: str = "id", key: str = "id") -> DataFrame:
    """Ids of requests whose ``column`` names no row of ``base``."""
    known = base.select(F.col(key).alias(column))
    return requests.select("request_id", column).join(known, column, "left_anti").select("request_id")


def repeats(requests: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Ids of requests that are not the first of the batch on their key."""
    first = requests.groupBy(*keys).agg(F.min("request_id").alias("_first"))
    return requests.select("request_id", *keys).join(first, list(keys)).filter(
        F.col("request_id") != F.col("_first")).select("request_id")


def compose(requests: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One sparse patch per id: for each column the last value given in the batch."""
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("request_id"))).alias(c) for c in columns
    ]
    return requests.groupBy("id").agg(*last)


def touch(df: DataFrame, changed: Column, ts: dt.datetime | Column) -> DataFrame:
    """Set ``updated_at`` on changed rows."""
    moment = ts if isinstance(ts, Column) else F.lit(ts)
    kind = df.schema["updated_at"].dataType
    return df.withColumn("updated_at", F.when(changed, moment.cast(kind)).otherwise(F.col("updated_at")))


def replaced(
    base: DataFrame, table: str, patch: DataFrame, columns: Sequence[str], now: dt.datetime,
    keep_null: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """New state of ``base`` under one patch row per id, and the altered rows.

    ``keep_null``: a NULL in the patch keeps the old value; otherwise it is written.
    """
    new = patch.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, "id", "left")
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        kind = base.schema[c].dataType
        given = F.col(f"_new_{c}").cast(kind)
        if keep_null:
            return F.coalesce(given, F.col(c))
        return F.when(hit, given).otherwise(F.col(c))

    state = joined.withColumns({c: value(c) for c in columns})
    if table in TOUCHED:
        state = touch(state, hit, now)
    return state.select(*base.columns), state.filter(hit).select(*base.columns)


def inserted(
    base: DataFrame, table: str, rows: DataFrame, ids: Ids, now: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """New state of ``base`` with the rows added, and the rows as stored (defaults filled)."""
    full = ensure_columns(base, table)
    kinds = {f.name: f.dataType for f in full.schema.fields}
    ready = apply_defaults(rows.withColumn("id", ids(table)), table, now=now)
    stored = ready.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return full.unionByName(stored), stored


def removed(base: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """``base`` without the rows whose ``column`` is among the keys."""
    return base.join(keys.toDF(column), column, "left_anti").select(*base.columns)


def entries(
    accepted: DataFrame, action: Column | str, entity_type: str, entity_id: Column | str | None,
    now: dt.datetime, details: Sequence[Column] = (), marks: Sequence[Column] = (),
) -> DataFrame:
    """Activity rows of accepted requests; ``marks`` follow the time stamp in the details.

    The actor comes from the optional request columns actor_id, ip_address, user_agent.
    """
    def optional(c: str) -> Column:
        return F.col(c) if c in accepted.columns else F.lit(None).cast("string")

    stamp = F.lit(time_stamp(now)).alias("timestamp")
    target = F.lit(None).cast("string") if entity_id is None else (
        F.col(entity_id) if isinstance(entity_id, str) else entity_id)
    return accepted.select(
        "request_id",
        optional("actor_id").alias("user_id"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        F.lit(entity_type).alias("entity_type"),
        target.alias("entity_id"),
        F.to_json(F.struct(*details, stamp, *marks)).alias("details"),
        clean_ip(optional("ip_address")).alias("ip_address"),
        optional("user_agent").alias("user_agent"),
        F.lit(now).alias("created_at"),
    )


def append_activity(
    logs: DataFrame, activity: DataFrame, ids: Ids | None = None, batch: str = ""
) -> DataFrame:
    """The log with the activity rows of a change added.

    Ids follow from all that tells rows of a batch apart; ``batch`` names it where request ids are
    used again at the same moment.
    """
    full = ensure_columns(logs, "activity_logs")
    parts = ("action", "entity_type", "entity_id", "request_id", "created_at", "details")
    new_id = ids("activity_logs") if ids else derived_id(
        "activity_logs", F.lit(batch), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    rows = activity.withColumn("id", new_id)
    return full.unionByName(rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in full.schema.fields]))


def system_entry(
    frame: DataFrame, action: str, entity_type: str, now: dt.datetime, details: Sequence[Column]
) -> DataFrame:
    """Activity rows without a user, marked ``system``; one per row of ``frame(request_id, ...)``."""
    marked = entries(frame, action, entity_type, None, now, details, [F.lit(True).alias("system")])
    return marked.withColumn("user_id", F.lit(None).cast("string"))
