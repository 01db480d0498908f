"""Registered queries: constraint scans and request validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.book import register
from tradebook.operators import quality
from tradebook.sources.model import SCHEMAS, ensure_columns


def staged(d):
    return {name: ensure_columns(d[f"staged_{name}"], name) for name in SCHEMAS}


def broken(table: str, rule: str, source: str, where: str, value: str, row_id: str = "id") -> str:
    return (f"""SELECT '{table}' AS "table", '{rule}' AS rule, cast({row_id} AS varchar) AS row_id, """
            f"""cast({value} AS varchar) AS value FROM {source} WHERE {where}""")


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# The oracle states each constraint anew: NOT NULL columns, domains, longest texts.
_PRESENT = {
    "users": "username", "clients": "name legal_name mb pib address", "products": "code name price",
    "invoices": "number date due_date client_id subtotal vat_amount total",
    "invoice_items": "invoice_id product_id quantity unit_price total_price",
    "deliveries": "number date due_date client_id", "delivery_items": "delivery_id product_id quantity",
    "product_groups": "name quantity_type original_quantity current_quantity shipment_date reservation_type",
    "product_group_items": "group_id product_id", "activity_logs": "action",
}
_DOMAIN = [
    ("users", "role", "role NOT IN ('admin', 'user')"), ("products", "price", "price < 0"), ("products", "weight", "weight < 0"),
    ("invoices", "vat_rate", "vat_rate < 0 OR vat_rate > 100"), ("invoices", "subtotal", "subtotal < 0"),
    ("invoices", "vat_amount", "vat_amount < 0"), ("invoices", "total", "total < 0"),
    ("invoices", "status", "status NOT IN ('draft', 'confirmed')"), ("invoice_items", "quantity", "quantity <= 0"),
    ("invoice_items", "unit_price", "unit_price < 0"), ("invoice_items", "total_price", "total_price < 0"),
    ("deliveries", "status", "status NOT IN ('draft', 'confirmed')"), ("delivery_items", "quantity", "quantity <= 0"),
    ("product_groups", "quantity_type", "quantity_type NOT IN ('weight', 'units')"),
    ("product_groups", "original_quantity", "original_quantity <= 0"), ("product_groups", "current_quantity", "current_quantity < 0"),
    ("product_groups", "reservation_type", "reservation_type NOT IN ('weight', 'units')"),
    ("product_groups", "reservation_amount", "reservation_amount < 0"),
]
_LONGEST = [
    ("users", "username", 50), ("users", "email", 255), ("clients", "name", 255), ("clients", "mb", 20), ("clients", "pib", 20),
    ("products", "code", 50), ("products", "name", 255), ("products", "category", 100), ("invoices", "number", 50),
    ("deliveries", "number", 50), ("delivery_items", "unit", 20), ("product_groups", "name", 255), ("activity_logs", "action", 255),
]
_CONSTRAINTS = union(
    [broken(t, f"{c}_required", f"staged_{t}", f"{c} IS NULL", "NULL") for t, cs in _PRESENT.items() for c in cs.split()]
    + [broken(t, f"{c}_check", f"staged_{t}", w, c) for t, c, w in _DOMAIN]
    + [broken(t, f"{c}_length", f"staged_{t}", f"length({c}) > {n}", c) for t, c, n in _LONGEST]
)
register("check_constraints", lambda d: quality.check_constraints(staged(d)), _CONSTRAINTS)
register(
    "rule_summary", lambda d: quality.rule_summary(quality.check_constraints(staged(d))),
    f'SELECT "table", rule, count(*) AS violations FROM ({_CONSTRAINTS}) v GROUP BY ALL',
)


def _shared(table: str, *key: str) -> str:
    first = " AND ".join(f"{k} IS NOT NULL" for k in key)
    cols = ", ".join(key)
    value = "concat_ws('|', " + cols + ")"
    return broken(table, "unique_" + "_".join(key),
                  f"(SELECT *, count(*) OVER (PARTITION BY {cols}) AS n FROM staged_{table} WHERE {first}) s", "n > 1", value)


register(
    "check_unique", lambda d: quality.check_unique(staged(d)),
    union([_shared("users", "username"), _shared("users", "email"), _shared("clients", "mb"), _shared("clients", "pib"),
           _shared("products", "code"), _shared("invoices", "number"), _shared("deliveries", "number"),
           _shared("product_group_items", "group_id", "product_id")]),
)
_PARENTS = [
    ("clients", "created_by", "users"), ("invoices", "client_id", "clients"), ("invoice_items", "invoice_id", "invoices"),
    ("invoice_items", "product_id", "products"), ("deliveries", "client_id", "clients"),
    ("delivery_items", "delivery_id", "deliveries"), ("delivery_items", "product_id", "products"),
    ("product_group_items", "group_id", "product_groups"), ("product_group_items", "product_id", "products"),
    ("activity_logs", "user_id", "users"),
]
register(
    "check_references", lambda d: quality.check_references(staged(d)),
    union([broken(t, f"{c}_exists", f"staged_{t} x", f"x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM staged_{p} y WHERE y.id = x.{c})", f"x.{c}", "x.id")
           for t, c, p in _PARENTS]),
)

# --- requests

_MAIL = r"(email LIKE '%@%.%' AND email NOT LIKE '% %')"


def sized(table: str, source: str, column: str, least: int, most: int) -> str:
    return broken(table, f"{column}_length", source, f"length(trim(coalesce({column}, ''))) NOT BETWEEN {least} AND {most}", column, "request_id")


def formed(table: str, source: str, column: str, wrong: str) -> str:
    return broken(table, f"{column}_form", source, wrong, column, "request_id")


USERS_SQL = [
    sized("users", "user_requests", "username", 3, 50),
    formed("users", "user_requests", "username", "NOT regexp_full_match(trim(username), '[a-zA-Z0-9_а-яА-Я]+')"),
    formed("users", "user_requests", "email", f"email IS NOT NULL AND NOT {_MAIL}"),
]
CLIENTS_SQL = [
    *[sized("clients", "client_requests", c, 1, n) for c, n in (("name", 255), ("legal_name", 255), ("mb", 20), ("pib", 20))],
    formed("clients", "client_requests", "email", f"email IS NOT NULL AND NOT {_MAIL}"),
    formed("clients", "client_requests", "installment_term", "installment_term IS NOT NULL AND coalesce(try_cast(installment_term AS hugeint), 0) < 1"),
    formed("clients", "client_requests", "google_maps_link", "NOT regexp_matches(google_maps_link, '^(https?|ftp)://')"),
]
PRODUCTS_SQL = [
    sized("products", "product_requests", "code", 1, 50), sized("products", "product_requests", "name", 1, 255),
    formed("products", "product_requests", "price", "coalesce(try_cast(price AS double), -1) < 0"),
    formed("products", "product_requests", "weight", "weight IS NOT NULL AND coalesce(try_cast(weight AS double), -1) < 0"),
    formed("products", "product_requests", "is_active", "is_active NOT IN ('true', 'false', '1', '0')"),
]


def _document_sql(table: str, source: str, lines: list[str]) -> list[str]:
    return [
        sized(table, source, "number", 1, 50),
        formed(table, source, "date", "try_cast(date AS date) IS NULL"),
        formed(table, source, "due_date", "try_cast(due_date AS date) IS NULL"),
        broken(table, "items_required", f"{source} r", "NOT EXISTS (SELECT 1 FROM invoice_request_lines l WHERE l.request_id = r.request_id)", "NULL", "r.request_id"),
        broken(table, "items_quantity_form", "invoice_request_lines", "coalesce(try_cast(quantity AS hugeint), 0) < 1", "quantity", "request_id || ':' || line_no"),
        *lines,
    ]


INVOICES_SQL = _document_sql("invoices", "invoice_requests", [
    formed("invoices", "invoice_requests", "vat_rate", "coalesce(try_cast(vat_rate AS double), -1) NOT BETWEEN 0 AND 100"),
    broken("invoices", "items_unit_price_form", "invoice_request_lines", "coalesce(try_cast(unit_price AS double), -1) < 0", "unit_price", "request_id || ':' || line_no"),
])
DELIVERIES_SQL = _document_sql("deliveries", "delivery_requests", [])
GROUPS_SQL = [
    sized("product_groups", "group_requests", "name", 1, 255),
    formed("product_groups", "group_requests", "quantity_type", "quantity_type NOT IN ('weight', 'units')"),
    formed("product_groups", "group_requests", "original_quantity", "coalesce(try_cast(original_quantity AS double), 0) < 0.01"),
    formed("product_groups", "group_requests", "shipment_date", "try_cast(shipment_date AS date) IS NULL"),
    formed("product_groups", "group_requests", "reservation_amount", "reservation_amount IS NOT NULL AND coalesce(try_cast(reservation_amount AS double), -1) < 0"),
]
register("validate_users", lambda d: quality.validate_users(d.user_requests), union(USERS_SQL))
register("validate_clients", lambda d: quality.validate_clients(d.client_requests), union(CLIENTS_SQL))
register("validate_products", lambda d: quality.validate_products(d.product_requests), union(PRODUCTS_SQL))
register("validate_invoices", lambda d: quality.validate_invoices(d.invoice_requests, d.invoice_request_lines), union(INVOICES_SQL))
register("validate_deliveries", lambda d: quality.validate_deliveries(d.delivery_requests, d.invoice_request_lines), union(DELIVERIES_SQL))
# Ids as text: most in the form of a UUID, one in seven without hyphens, one in eleven cut short.
_TEXT_ID = """CASE WHEN {0} % 7 = 0 THEN concat('00000000000040008000', lpad(cast({0} AS string), 12, '0'))
    WHEN {0} % 11 = 0 THEN concat('00000000-0000-4000-8000-', lpad(cast({0} AS string), 11, '0'))
    WHEN {0} IS NOT NULL THEN concat('ABCDEF00-0000-4000-8000-', lpad(cast({0} AS string), 12, '0')) END"""


def _text_ids(validate, requests: str):
    """The requests with ids as text; a negative number makes no UUID either."""
    return lambda d: validate(
        d[requests].withColumn("client_id", F.expr(_TEXT_ID.format("client_id"))),
        d.invoice_request_lines.withColumn("product_id", F.expr(_TEXT_ID.format("product_id")))).filter("rule LIKE '%_id_form'")


def _text_ids_sql(requests: str, table: str) -> str:
    odd = "({0} % 7 = 0 OR {0} % 11 = 0 OR {0} < 0)"
    return f"""SELECT '{table}' AS "table", 'client_id_form' AS rule, cast(request_id AS varchar) AS row_id, {_TEXT_ID.format('client_id')} AS value
        FROM {requests} WHERE {odd.format('client_id')}
        UNION ALL SELECT '{table}', 'items_product_id_form', request_id || ':' || line_no, {_TEXT_ID.format('product_id')}
        FROM invoice_request_lines WHERE {odd.format('product_id')}"""


register("validate_invoices_text_ids", _text_ids(quality.validate_invoices, "invoice_requests"), _text_ids_sql("invoice_requests", "invoices"))
register("validate_deliveries_text_ids", _text_ids(quality.validate_deliveries, "delivery_requests"), _text_ids_sql("delivery_requests", "deliveries"))
register("validate_groups", lambda d: quality.validate_groups(d.group_requests), union(GROUPS_SQL))

_SUMS = """(SELECT i.id, i.subtotal, i.vat_amount, i.total, cast(coalesce(sum(l.total_price), 0) AS decimal(18,2)) AS s, i.vat_rate
    FROM staged_invoices i LEFT JOIN staged_invoice_items l ON l.invoice_id = i.id GROUP BY ALL) h"""


def _half_up(cents_of_cents: str) -> str:
    """Whole cents from an amount in hundredths of a cent, halves away from zero."""
    return f"(sign({cents_of_cents}) * ((abs({cents_of_cents}) + 50) // 100))"


# Stored minus expected, in cents; s * rate is VAT in hundredths of a cent for whole-number rates.
_VAT = "cast(s * 100 AS hugeint) * cast(vat_rate AS hugeint)"
_OFF = {
    "subtotal": "cast(subtotal * 100 AS hugeint) - cast(s * 100 AS hugeint)",
    "vat_amount": f"cast(vat_amount * 100 AS hugeint) - {_half_up(_VAT)}",
    "total": f"cast(total * 100 AS hugeint) - {_half_up(f'(cast(s * 100 AS hugeint) * 100 + {_VAT})')}",
}
register(
    "reconcile_invoices",
    lambda d: quality.reconcile_invoices(staged(d)["invoices"], staged(d)["invoice_items"]),
    union([
        broken("invoice_items", "line_total", "staged_invoice_items", "total_price <> unit_price * quantity",
               "cast(total_price - unit_price * quantity AS decimal(18,2))"),
        *[broken("invoices", rule, _SUMS, f"abs({off}) > 1", f"cast(cast({off} AS decimal(18,0)) / 100 AS decimal(18,2))")
          for rule, off in _OFF.items()],
    ]),
)
