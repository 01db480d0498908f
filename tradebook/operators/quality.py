"""Data rules as table scans.

Every operator returns violations (table, rule, row_id, value). Row rules of a table are evaluated
together in one pass; only uniqueness and foreign keys shuffle.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import (
    USERNAME, is_boolean, is_date, is_email, is_integer, is_number, is_url, is_uuid, line_total,
    total_with_vat, trimmed, trimmed_length, vat_of,
)
from tradebook.session import pinned

Tables = Mapping[str, DataFrame]

# Columns that must not be NULL.
REQUIRED: dict[str, tuple[str, ...]] = {
    "users": ("username",),
    "clients": ("name", "legal_name", "mb", "pib", "address"),
    "products": ("code", "name", "price"),
    "invoices": ("number", "date", "due_date", "client_id", "subtotal", "vat_amount", "total"),
    "invoice_items": ("invoice_id", "product_id", "quantity", "unit_price", "total_price"),
    "deliveries": ("number", "date", "due_date", "client_id"),
    "delivery_items": ("delivery_id", "product_id", "quantity"),
    "product_groups": (
        "name", "quantity_type", "original_quantity", "current_quantity", "shipment_date",
        "reservation_type",
    ),
    "product_group_items": ("group_id", "product_id"),
    "activity_logs": ("action",),
}

# Domain of a column as a predicate; NULL passes.
CHECKS: dict[str, dict[str, str]] = {
    "users": {"role": "role IN ('admin', 'user')"},
    "products": {"price": "price >= 0", "weight": "weight >= 0"},
    "invoices": {
        "vat_rate": "vat_rate BETWEEN 0 AND 100", "subtotal": "subtotal >= 0",
        "vat_amount": "vat_amount >= 0", "total": "total >= 0",
        "status": "status IN ('draft', 'confirmed')",
    },
    "invoice_items": {
        "quantity": "quantity > 0", "unit_price": "unit_price >= 0", "total_price": "total_price >= 0",
    },
    "deliveries": {"status": "status IN ('draft', 'confirmed')"},
    "delivery_items": {"quantity": "quantity > 0"},
    "product_groups": {
        "quantity_type": "quantity_type IN ('weight', 'units')",
        "original_quantity": "original_quantity > 0", "current_quantity": "current_quantity >= 0",
        "reservation_type": "reservation_type IN ('weight', 'units')",
        "reservation_amount": "reservation_amount >= 0",
    },
}

# Longest text a column takes.
LENGTHS: dict[str, dict[str, int]] = {
    "users": {"username": 50, "email": 255, "full_name": 255, "role": 20},
    "clients": {
        "name": 255, "legal_name": 255, "mb": 20, "pib": 20, "city": 100, "municipality": 100,
        "street": 255, "house_number": 20, "contact_person": 255, "telegram": 255,
        "instagram": 255, "phone": 50, "email": 255,
    },
    "products": {"code": 50, "name": 255, "category": 100},
    "invoices": {"number": 50, "reference": 50, "status": 20},
    "deliveries": {"number": 50, "delivery_method": 100, "status": 20},
    "delivery_items": {"unit": 20},
    "product_groups": {"name": 255, "quantity_type": 10, "reservation_type": 10},
    "activity_logs": {"action": 255, "entity_type": 50},
}

# Unique keys.
UNIQUES: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("username",), ("email",)),
    "clients": (("mb",), ("pib",)),
    "products": (("code",),),
    "invoices": (("number",),),
    "deliveries": (("number",),),
    "product_group_items": (("group_id", "product_id"),),
}

# Foreign keys as (table, column, parent).
REFERENCES: tuple[tuple[str, str, str], ...] = (
    ("clients", "created_by", "users"),
    ("products", "created_by", "users"),
    ("invoices", "client_id", "clients"),
    ("invoices", "created_by", "users"),
    ("invoice_items", "invoice_id", "invoices"),
    ("invoice_items", "product_id", "products"),
    ("deliveries", "client_id", "clients"),
    ("deliveries", "created_by", "users"),
    ("delivery_items", "delivery_id", "deliveries"),
    ("delivery_items", "product_id", "products"),
    ("product_groups", "created_by", "users"),
    ("product_group_items", "group_id", "product_groups"),
    ("product_group_items", "product_id", "products"),
    ("activity_logs", "user_id", "users"),
)


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule when ``ok`` is false; an unknown (NULL) outcome passes."""

    name: str
    column: str
    ok: Column


def breaks(rules: Sequence[Rule]) -> Column:
    """True when a row breaks any of the rules; NULL or false otherwise."""
    return ~functools.reduce(operator.and_, [r.ok for r in rules])


def violations(
    df: DataFrame, table: str, rules: Sequence[Rule], row_id: Column | str = "id", keep: Sequence[str] = ()
) -> DataFrame:
    """All rules over one scan; only rows that break one are expanded, to one row per broken rule.

    ``keep`` names columns to carry along.
    """
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    marks = [
        F.when(~r.ok, F.expr(f"named_struct('rule', '{r.name}', 'value', cast({r.column} AS string))"))
        for r in rules
    ]
    found = df.filter(breaks(rules)).select(
        row_id.cast("string").alias("row_id"), *keep, F.inline(F.array_compact(F.array(*marks))))
    return found.select(F.lit(table).alias("table"), "rule", "row_id", "value", *keep)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def table_rules(table: str) -> list[Rule]:
    rules = [Rule(f"{c}_required", c, F.col(c).isNotNull()) for c in REQUIRED.get(table, ())]
    rules += [Rule(f"{c}_check", c, F.expr(p)) for c, p in CHECKS.get(table, {}).items()]
    rules += [Rule(f"{c}_length", c, F.length(c) <= n) for c, n in LENGTHS.get(table, {}).items()]
    return rules


def check_constraints(t: Tables) -> DataFrame:
    """NOT NULL, CHECK and length rules of every table in ``t``."""
    return _union([violations(df, name, table_rules(name)) for name, df in t.items()])


def check_unique(t: Tables) -> DataFrame:
    """All rows sharing a unique key with another row; keys with a NULL part do not collide."""
    parts = []
    for name, keys in UNIQUES.items():
        if name not in t:
            continue
        for key in keys:
            rows = t[name].select("id", *key).dropna(subset=list(key))
            shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            parts.append(rows.join(shared.select(*key), list(key), "left_semi").select(
                F.lit(name).alias("table"), F.lit("unique_" + "_".join(key)).alias("rule"),
                F.col("id").cast("string").alias("row_id"), F.concat_ws("|", *key).alias("value")))
    return _union(parts)


def unknown_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct values of the one column of ``keys`` that ``known``, of one column too, does not have; no NULL.

    Only key values are shuffled. Those few that are unknown, as a rule, reach all rows that name them by a broadcast.
    """
    name = keys.columns[0]
    return keys.dropna().distinct().join(known.toDF(name), name, "left_anti")


def check_references(t: Tables) -> DataFrame:
    """Rows whose foreign key names no parent row; NULL passes.

    The missing keys are written first, so that their number is known when the rows are joined with them.
    """
    used = [(name, column, parent) for name, column, parent in REFERENCES if name in t and parent in t]
    missing = pinned(_union([
        unknown_keys(t[name].select(F.col(column).alias("_k")), t[parent].select("id")).select(
            F.lit(i).alias("_at"), F.col("_k").cast("string").alias("_k"))
        for i, (name, column, parent) in enumerate(used)]))
    parts = []
    for i, (name, column, _) in enumerate(used):
        child = t[name].select("id", F.col(column).cast("string").alias("_k")).filter("_k IS NOT NULL")
        parts.append(child.join(missing.filter(F.col("_at") == i).select("_k"), "_k", "left_semi").select(
            F.lit(name).alias("table"), F.lit(f"{column}_exists").alias("rule"),
            F.col("id").cast("string").alias("row_id"), F.col("_k").alias("value")))
    return _union(parts)


def rule_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("violations"))


# --- rules for incoming requests, whose fields are raw text

def _text(column: str, most: int | None, least: int = 0) -> Rule:
    """Trimmed length between the bounds; an absent optional field passes."""
    size = trimmed_length(column)
    ok = size >= least if most is None else size.between(least, most)
    return Rule(f"{column}_length", column, ok if least else F.col(column).isNull() | ok)


def _form(column: str, ok: Column, required: bool = False) -> Rule:
    """The field has the right form; absent passes unless required."""
    judged = F.coalesce(ok, F.lit(False))
    return Rule(f"{column}_form", column, judged if required else F.col(column).isNull() | judged)


def user_rules() -> list[Rule]:
    return [
        _text("username", 50, 3),
        _form("username", trimmed("username").rlike(USERNAME), required=True),
        _form("email", is_email("email")),
        _text("full_name", 255),
    ]


def client_rules() -> list[Rule]:
    return [
        _text("name", 255, 1), _text("legal_name", 255, 1), _text("mb", 20, 1), _text("pib", 20, 1),
        _text("address", None, 1), _text("city", 100), _text("municipality", 100), _text("street", 255),
        _text("house_number", 20), _form("google_maps_link", is_url("google_maps_link")),
        _text("contact_person", 255), _text("telegram", 255), _text("instagram", 255),
        _text("phone", 50), _form("email", is_email("email")),
        _form("installment_payment", is_boolean("installment_payment")),
        _form("installment_term", is_integer("installment_term", 1)),
        _form("showcase", is_boolean("showcase")), _form("bar", is_boolean("bar")), _text("notes", 1000),
    ]


def product_rules() -> list[Rule]:
    return [
        _text("code", 50, 1), _text("name", 255, 1), _form("price", is_number("price", 0), required=True),
        _form("weight", is_number("weight", 0)), _text("category", 100), _text("description", 1000),
        _form("is_active", is_boolean("is_active")),
    ]


def invoice_rules() -> list[Rule]:
    return [
        _text("number", 50, 1), _form("date", is_date("date"), required=True),
        _form("due_date", is_date("due_date"), required=True),
        Rule("client_id_required", "client_id", F.col("client_id").isNotNull()),
        _text("delivery_address", 500), _form("vat_rate", is_number("vat_rate", 0, 100), required=True),
        _text("reference", 50), _text("notes", 1000),
    ]


def delivery_rules() -> list[Rule]:
    return [
        _text("number", 50, 1), _form("date", is_date("date"), required=True),
        _form("due_date", is_date("due_date"), required=True),
        Rule("client_id_required", "client_id", F.col("client_id").isNotNull()),
        _text("delivery_method", 100), _text("notes", 1000),
    ]


def invoice_line_rules() -> list[Rule]:
    return [
        Rule("items_product_id_required", "product_id", F.col("product_id").isNotNull()),
        Rule("items_quantity_form", "quantity", F.coalesce(is_integer("quantity", 1), F.lit(False))),
        Rule("items_unit_price_form", "unit_price", F.coalesce(is_number("unit_price", 0), F.lit(False))),
    ]


def delivery_line_rules() -> list[Rule]:
    return [
        Rule("items_product_id_required", "product_id", F.col("product_id").isNotNull()),
        Rule("items_quantity_form", "quantity", F.coalesce(is_integer("quantity", 1), F.lit(False))),
        Rule("items_unit_length", "unit", F.col("unit").isNull() | (trimmed_length("unit") <= 20)),
    ]


def group_rules() -> list[Rule]:
    return [
        _text("name", 255, 1),
        _form("quantity_type", F.col("quantity_type").isin("weight", "units"), required=True),
        _form("original_quantity", is_number("original_quantity", 0.01), required=True),
        _form("shipment_date", is_date("shipment_date"), required=True),
        _form("reservation_type", F.col("reservation_type").isin("weight", "units"), required=True),
        _form("reservation_amount", is_number("reservation_amount", 0)),
    ]


# Rules of the sparse group patch: the same forms, every field optional.
def group_patch_rules() -> list[Rule]:
    return [
        Rule("name_length", "name", F.col("name").isNull() | trimmed_length("name").between(1, 255)),
        _form("quantity_type", F.col("quantity_type").isin("weight", "units")),
        _form("original_quantity", is_number("original_quantity", 0.01)),
        _form("shipment_date", is_date("shipment_date")),
        _form("reservation_type", F.col("reservation_type").isin("weight", "units")),
        _form("reservation_amount", is_number("reservation_amount", 0)),
    ]


def with_fields(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the fields the rules read and the requests lack, as NULL."""
    missing = {r.column for r in rules} - set(df.columns)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in sorted(missing)])


def _requests(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    return violations(with_fields(df, rules), table, rules, "request_id", ["request_id"])


def unnest_items(requests: DataFrame) -> DataFrame:
    """Lines (request_id, line_no, item fields) of requests that carry an ``items`` array."""
    lines = requests.select("request_id", F.posexplode("items").alias("_at", "_item"))
    return lines.select("request_id", (F.col("_at") + 1).alias("line_no"), "_item.*")


def _documents(
    requests: DataFrame, lines: DataFrame, table: str, rules: Sequence[Rule], line_rules: Sequence[Rule]
) -> DataFrame:
    """Header rules, the need for at least one line, and line rules per line (row id 'request:line')."""
    heads = _requests(requests, table, rules)
    with_lines = lines.select("request_id").distinct()
    bare = requests.join(with_lines, "request_id", "left_anti").select(
        F.lit(table).alias("table"), F.lit("items_required").alias("rule"),
        F.col("request_id").cast("string").alias("row_id"), F.lit(None).cast("string").alias("value"),
        "request_id")
    each = violations(with_fields(lines, line_rules), table, line_rules,
                      F.concat_ws(":", "request_id", "line_no"), ["request_id"])
    return _union([heads, bare, each])


def id_rules(df: DataFrame, column: str, name: str) -> list[Rule]:
    """Ids given as text have the form of a UUID; ids of other types have no form."""
    if column not in df.columns or df.schema[column].dataType.typeName() not in ("string", "char", "varchar"):
        return []
    return [Rule(name, column, F.col(column).isNull() | F.coalesce(is_uuid(column), F.lit(False)))]


def request_violations(
    table: str, requests: DataFrame, lines: DataFrame | None = None, sparse: bool = False, uuids: bool = False
) -> DataFrame:
    """Violations of a batch of requests, with the ``request_id`` of each; ``uuids``: ids given as text must be UUIDs."""
    if table in ("invoices", "deliveries"):
        heads, each = (invoice_rules(), invoice_line_rules()) if table == "invoices" else (delivery_rules(), delivery_line_rules())
        if uuids:
            heads = heads + id_rules(requests, "client_id", "client_id_form")
            each = each + id_rules(lines, "product_id", "items_product_id_form")
        return _documents(requests, lines, table, heads, each)
    rules = {
        "users": user_rules, "clients": client_rules, "products": product_rules,
        "product_groups": group_patch_rules if sparse else group_rules,
    }
    return _requests(requests, table, rules[table]())


def validate_users(requests: DataFrame) -> DataFrame:
    return request_violations("users", requests).drop("request_id")


def validate_clients(requests: DataFrame) -> DataFrame:
    return request_violations("clients", requests).drop("request_id")


def validate_products(requests: DataFrame) -> DataFrame:
    return request_violations("products", requests).drop("request_id")


def validate_groups(requests: DataFrame, sparse: bool = False) -> DataFrame:
    return request_violations("product_groups", requests, sparse=sparse).drop("request_id")


def validate_invoices(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids are checked for the form of a UUID where they are text."""
    return request_violations("invoices", requests, lines, uuids=True).drop("request_id")


def validate_deliveries(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids are checked for the form of a UUID where they are text."""
    return request_violations("deliveries", requests, lines, uuids=True).drop("request_id")


WIDE = "decimal(24,2)"


def reconcile_invoices(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Line totals that are not quantity x price, and headers that do not follow from their lines.

    ``value`` is stored minus expected. Headers may differ by 0.01; lines must match. Expected
    amounts may be larger than the columns hold.
    """
    off = F.col("total_price") - line_total("quantity", "unit_price", WIDE)
    lines = items.filter(off != 0).select(
        F.lit("invoice_items").alias("table"), F.lit("line_total").alias("rule"),
        F.col("id").cast("string").alias("row_id"), off.cast("string").alias("value"))
    sums = items.groupBy(F.col("invoice_id").alias("id")).agg(F.sum("total_price").alias("_sum"))
    base = F.coalesce("_sum", F.lit(0).cast("decimal(22,2)")).cast("decimal(18,2)")
    heads = invoices.select("id", "subtotal", "vat_amount", "total", "vat_rate").join(sums, "id", "left")
    heads = heads.select(
        "id",
        (F.col("subtotal") - base).cast(WIDE).alias("subtotal"),
        (F.col("vat_amount") - vat_of(base, "vat_rate", WIDE)).cast(WIDE).alias("vat_amount"),
        (F.col("total") - total_with_vat(base, "vat_rate", WIDE)).cast(WIDE).alias("total"),
    )
    close = F.lit("0.01").cast("decimal(3,2)")
    rules = [Rule(c, c, F.abs(c) <= close) for c in ("subtotal", "vat_amount", "total")]
    return lines.unionByName(violations(heads, "invoices", rules))
