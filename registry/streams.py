"""Registered queries: streams, run over all files present, and their batch forms."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from registry.book import register
from registry.views import VIEWS, Data
from registry.warehouse import BALANCE_SQL, lines_sql
from tradebook.session import scratch_path
from tradebook.sources.model import ensure_columns
from tradebook.streaming.activity import (
    activity_stream, activity_windows, file_stream, kept_counts, rate_stream, request_rate, windows_stream,
)
from tradebook.streaming.confirmations import stock_stream

_DAY = "date_trunc('day', created_at)"
_WINDOWS = f"""SELECT {_DAY} AS window_start, {_DAY} + INTERVAL 1 DAY AS window_end, entity_type, user_id, count(*) AS actions
    FROM activity_logs GROUP BY ALL"""
register("activity_windows", lambda d: activity_windows(d.activity_logs), _WINDOWS)
_QUARTER = "time_bucket(INTERVAL 15 MINUTE, created_at)"
_RATE = f"""SELECT {_QUARTER} AS window_start, {_QUARTER} + INTERVAL 15 MINUTE AS window_end, ip_address, count(*) AS requests
    FROM activity_logs GROUP BY ALL HAVING count(*) > 1"""
register("request_rate", lambda d: request_rate(d.activity_logs, limit=1), _RATE)


def log_stream(d: Data):
    """The events file as a stream, put into the form of the log by the text of its view."""
    events = file_stream(d.spark, d.sf_dir, d.events.schema, "events.parquet")
    events.createOrReplaceTempView("events_as_stream")
    rows = d.spark.sql(re.sub(r"\bFROM events\b", "FROM events_as_stream", VIEWS["activity_logs"]))
    return ensure_columns(rows, "activity_logs")


def _streamed_windows(d: Data):
    """What the counting stream holds once all files are worked off."""
    store, out, checkpoint = (scratch_path(d.spark, f"windows-{part}") for part in ("log", "out", "checkpoint"))
    windows_stream(log_stream(d), store, out, checkpoint).awaitTermination()
    return kept_counts(d.spark, out, activity_windows(d.activity_logs).schema)


register("activity_windows_stream", _streamed_windows, _WINDOWS)


def _streamed_rates(d: Data):
    out, checkpoint = (scratch_path(d.spark, f"rates-{part}") for part in ("out", "checkpoint"))
    rate_stream(log_stream(d), out, checkpoint).awaitTermination()
    return kept_counts(d.spark, out, request_rate(d.activity_logs).schema).filter("requests > 1")


register("request_rate_stream", _streamed_rates, _RATE)


def _stored_log(d: Data):
    path = scratch_path(d.spark, "log")
    activity_stream(log_stream(d), path, scratch_path(d.spark, "log-checkpoint")).awaitTermination()
    return d.spark.read.parquet(path).select("id", "user_id", "action", "created_at", "day")


register(
    "activity_stream", _stored_log,
    "SELECT id, user_id, action, created_at, cast(created_at AS date) AS day FROM activity_logs",
)

_CONFIRM = "CASE WHEN o_orderkey % 4 = 0 THEN 'draft' ELSE 'confirmed' END"


def _streamed_balance(d: Data):
    """Every order's invoice is confirmed or reopened by a stream; the closing balances."""
    orders = file_stream(d.spark, d.sf_dir, d.orders.schema, "orders.parquet")
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("id"), F.expr(_CONFIRM).alias("status"))
    tables = {n: d[n] for n in ("invoices", "invoice_items", "products", "product_group_items", "product_groups")}
    state = scratch_path(d.spark, "stock")
    stock_stream(requests, tables, state, scratch_path(d.spark, "stock-checkpoint")).awaitTermination()
    last = d.spark.read.parquet(f"{state}/balance")
    newest = last.agg(F.max("version").alias("v")).scalar()
    return last.filter(F.col("version") == newest).select("id", "name", "current_quantity")


register(
    "stock_stream", _streamed_balance,
    f"""WITH entered AS (SELECT o_orderkey AS request_id, i.id AS invoice_id, i.date FROM orders JOIN invoices i ON i.id = o_orderkey
          WHERE {_CONFIRM} = 'confirmed' AND i.status <> 'confirmed'), {lines_sql('entered')} {BALANCE_SQL}""",
)
