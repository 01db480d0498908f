"""Registered queries: the scalar functions, each over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.book import register
from tradebook.functions import expressions as x

NOW = dt.datetime(2024, 2, 1)

register(
    "text_functions",
    lambda d: d.client_requests.select(
        "request_id", x.trimmed("name").alias("name"), x.trimmed_length("name").alias("length"),
        x.normalized_email("email").alias("email"), F.coalesce(x.is_email("email"), F.lit(False)).alias("is_email"),
        x.is_url("google_maps_link").alias("is_url"), F.upper("legal_name").alias("upper"), F.lower("legal_name").alias("lower"),
        F.regexp_replace(F.lower("legal_name"), "[ #]", "_").alias("key"),
        F.concat(F.lit("Created client: "), F.col("legal_name")).alias("sentence"),
        F.replace("legal_name", F.lit("#"), F.lit('""')).alias("quoted"),
        F.coalesce(x.is_integer("installment_term", 1), F.lit(False)).alias("is_term")),
    """SELECT request_id, trim(name) AS name, cast(length(trim(name)) AS int) AS length, lower(email) AS email,
              coalesce(email LIKE '%@%.%', false) AS is_email, regexp_matches(google_maps_link, '^https?://') AS is_url,
              upper(legal_name) AS upper, lower(legal_name) AS lower, regexp_replace(lower(legal_name), '[ #]', '_', 'g') AS key,
              'Created client: ' || legal_name AS sentence, replace(legal_name, '#', '""') AS quoted,
              coalesce(try_cast(installment_term AS hugeint) >= 1, false) AS is_term FROM client_requests""",
)
# Given text, its normal form, and whether it reads as an address: every family of hosts, and hosts that only look like one.
_ADDRESSES = [
    ("A.B+t@Gmail.com", "ab@gmail.com", True), ("x.y@GoogleMail.com", "xy@gmail.com", True), ("q.r+t@Outlook.com", "q.r@outlook.com", True),
    ("q+t@hotmail.co.uk", "q@hotmail.co.uk", True), ("q+t@msn.com", "q@msn.com", True), ("q+t@live.nl", "q@live.nl", True),
    ("a+x@me.example.com", "a+x@me.example.com", True), ("a+y@live.example.org", "a+y@live.example.org", True),
    ("a+z@hotmail.example", "a+z@hotmail.example", True), ("k.l+z@iCloud.com", "k.l@icloud.com", True), ("k+z@me.com", "k@me.com", True),
    ("a-b-c@yahoo.com", "a-b@yahoo.com", True), ("a-b+c@ymail.com", "a@ymail.com", True), ("a-b@yahoo.example.com", "a-b@yahoo.example.com", True),
    ("a-b@yahoo.com.example", "a-b@yahoo.com.example", True), ("W.v+t@Ya.ru", "w.v+t@yandex.ru", True), ("w@yandex.kz", "w@yandex.ru", True),
    ("w@yandex.example", "w@yandex.example", True), (" U.V+w@Example.COM ", "u.v+w@example.com", False), ("+t@gmail.com", "+t@gmail.com", True),
    ("no address", "no address", False), ("a..b@example.com", "a..b@example.com", False), ("a@b", "a@b", False),
    ("a@-b.com", "a@-b.com", False), (None, None, False),
]
_LINKS = [
    ("http://a.co/x?y", True), ("ftp://a.b.co:21/z", True), ("a.co", True), ("htp:/bad", False), ("https://a", False),
    ("https://a.co/with space", False), ("javascript:alert(1)", False), ("https://-a.co", False), ("https://a.co#top", True),
]
_UUIDS = [
    ("123e4567-e89b-12d3-a456-426614174000", True), ("123E4567-E89B-12D3-A456-42661417400F", True), ("123e4567e89b12d3a456426614174000", False),
    ("{123e4567-e89b-12d3-a456-426614174000}", False), ("123e4567-e89b-12d3-a456-42661417400g", False), ("", False), (None, False),
]


def _text(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'"


def _dealt(values: list) -> str:
    """SQL: each request gets one of ``values``, in turn."""
    return f"CASE request_id % {len(values)} " + " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values)) + " END"


register(
    "text_forms",
    lambda d: d.client_requests.select(
        "request_id", *[F.expr(_dealt([row[0] for row in some])).alias(name) for name, some in (("e", _ADDRESSES), ("u", _LINKS), ("i", _UUIDS))],
    ).select(
        "request_id", x.normalized_email("e").alias("email"), F.coalesce(x.is_email("e"), F.lit(False)).alias("is_email"),
        x.is_url("u").alias("is_url"), F.coalesce(x.is_uuid("i"), F.lit(False)).alias("is_uuid")),
    f"""SELECT request_id, {_dealt([a[1] for a in _ADDRESSES])} AS email, {_dealt([a[2] for a in _ADDRESSES])} AS is_email,
        {_dealt([a[1] for a in _LINKS])} AS is_url, {_dealt([a[1] for a in _UUIDS])} AS is_uuid FROM client_requests""",
)
register(
    "number_functions",
    lambda d: d.group_requests.select(
        "request_id", F.coalesce(x.is_number("original_quantity", 0.01), F.lit(False)).alias("is_quantity"),
        F.coalesce(x.is_number("reservation_amount", 0), F.lit(False)).alias("is_amount"),
        x.initial_stock(F.col("original_quantity").try_cast("decimal(12,2)"), F.col("reservation_amount").try_cast("decimal(12,2)")).alias("initial"),
        x.line_total(F.col("request_id").cast("int"), F.col("original_quantity").try_cast("decimal(10,2)")).alias("line_total"),
        x.vat_of(F.col("original_quantity").try_cast("decimal(12,2)"), F.lit(20).cast("decimal(5,2)")).alias("vat"),
        x.total_with_vat(F.col("original_quantity").try_cast("decimal(12,2)"), F.lit(20).cast("decimal(5,2)")).alias("total"),
        F.ceil(F.col("request_id") / 7).cast("long").alias("pages"),
        F.greatest(F.lit(0), F.col("request_id") - 500).alias("clamped")),
    """SELECT request_id, original_quantity <> '0' AS is_quantity, coalesce(cast(reservation_amount AS int) >= 0, false) AS is_amount,
              cast(greatest(0, try_cast(original_quantity AS decimal(12,2)) * 0.95 - coalesce(cast(reservation_amount AS decimal(12,2)), 0)) AS decimal(12,2)) AS initial,
              try_cast(try_cast(original_quantity AS decimal(10,2)) * request_id AS decimal(12,2)) AS line_total,
              cast(try_cast(original_quantity AS decimal(12,2)) * 0.20 AS decimal(12,2)) AS vat, cast(try_cast(original_quantity AS decimal(12,2)) * 1.20 AS decimal(12,2)) AS total,
              cast(ceil(request_id / 7.0) AS bigint) AS pages, greatest(0, request_id - 500) AS clamped FROM group_requests""",
)
register(
    "time_functions",
    lambda d: d.activity_logs.select(
        "id", x.iso_utc("created_at").alias("iso"), F.to_date("created_at").alias("day"),
        F.trunc("created_at", "month").alias("month"), F.trunc("created_at", "quarter").alias("quarter"), F.trunc("created_at", "year").alias("year"),
        (F.col("created_at") >= F.lit(NOW - dt.timedelta(days=15))).alias("recent"), x.clean_ip("ip_address").alias("ip")),
    """SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, cast(created_at AS date) AS day, cast(date_trunc('month', created_at) AS date) AS month,
              cast(date_trunc('quarter', created_at) AS date) AS quarter, cast(date_trunc('year', created_at) AS date) AS year,
              created_at >= TIMESTAMP '2024-01-17' AS recent, CASE WHEN ip_address = '::1' THEN '127.0.0.1' ELSE ip_address END AS ip FROM activity_logs""",
)
register(
    "date_checks",
    lambda d: d.invoice_requests.select(
        "request_id", x.is_date("date").alias("is_date"), x.is_number("vat_rate", 0, 100).alias("is_rate"),
        x.is_boolean(F.lit("maybe")).alias("is_flag")),
    "SELECT request_id, try_cast(date AS date) IS NOT NULL AS is_date, cast(vat_rate AS int) BETWEEN 0 AND 100 AS is_rate, false AS is_flag FROM invoice_requests",
)
register(
    "json_functions",
    lambda d: d.activity_logs.select(
        "id", F.get_json_object("details", "$.k").alias("k"),
        F.from_json("details", "k int")["k"].alias("number"),
        F.to_json(F.struct("action", "entity_id")).alias("packed")),
    """SELECT id, json_extract_string(details, '$.k') AS k, cast(json_extract_string(details, '$.k') AS int) AS number,
              '{"action":"' || action || '","entity_id":' || entity_id || '}' AS packed FROM activity_logs""",
)
register(
    "array_functions",
    lambda d: d.clients.select("id", F.array_join(F.transform(F.filter(F.array("name", "email", "city"), lambda v: v != ""), F.upper), "; ").alias("parts")),
    "SELECT id, concat_ws('; ', upper(name), upper(email), upper(city)) AS parts FROM clients",
)
