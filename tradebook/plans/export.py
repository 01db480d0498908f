"""Report datasets with their printed labels; the sinks are in ``tradebook.sources.writers``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import active_label, iso_utc, yes_no
from tradebook.operators.changes import entries
from tradebook.operators.joins import with_client, with_product
from tradebook.operators.ordered import nest
from tradebook.operators.search import (
    active_only, between_dates, newest_first, relabel, search_any, where_all,
)
from tradebook.plans.reports import Indexes, list_logs, logs_found, named_logs

Tables = Mapping[str, DataFrame]
NAMES = {"name": "client_name", "legal_name": "client_legal_name"}


def _documents(
    headers: DataFrame, clients: DataFrame, status: str | None, client_id: object | None,
    start: dt.date | None, end: dt.date | None,
) -> DataFrame:
    picked = between_dates(where_all(headers, status=status, client_id=client_id), "date", start, end)
    return with_client(picked, clients, NAMES)


def usage_log(
    rows: DataFrame, action: str, table: str, now: dt.datetime, request_id: object = 0,
    file_format: str | None = None, filters: Mapping[str, object] | None = None,
) -> DataFrame:
    """One activity row about a dataset handed out: its action, row count, format and filters."""
    details = [F.col("count")]
    if file_format is not None:
        details.insert(0, F.lit(file_format).alias("format"))
    if filters is not None:
        given = [F.lit(None if v is None else str(v)).alias(k) for k, v in filters.items()]
        details.append(F.struct(*given).alias("filters"))
    counted = rows.agg(F.count(F.lit(1)).alias("count")).withColumn("request_id", F.lit(request_id))
    return entries(counted, action, table, None, now, details)


def export_log(
    rows: DataFrame, table: str, now: dt.datetime, request_id: object = 0,
    filters: Mapping[str, object] | None = None, file_format: str = "csv",
) -> DataFrame:
    return usage_log(rows, f"EXPORT_{table.upper()}", table, now, request_id, file_format, filters)


def view_log(rows: DataFrame, now: dt.datetime, request_id: object = 0) -> DataFrame:
    """The list of product groups was looked at."""
    return usage_log(rows, "VIEW_PRODUCT_GROUPS", "product_groups", now, request_id)


def export_invoices(
    t: Tables, status: str | None = None, client_id: object | None = None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    rows = _documents(t["invoices"], t["clients"], status, client_id, start, end)
    return relabel(rows.orderBy(F.desc("date"), "id"), {
        "Invoice Number": "number", "Date": "date", "Due Date": "due_date",
        "Client Name": "client_name", "Client Legal Name": "client_legal_name",
        "Subtotal": "subtotal", "VAT Amount": "vat_amount", "Total": "total", "Status": "status",
        "Delivered": yes_no("is_delivered"), "Paid": yes_no("is_paid"),
        "Notes": "notes", "Created At": "created_at",
    })


def export_deliveries(
    t: Tables, status: str | None = None, client_id: object | None = None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    rows = _documents(t["deliveries"], t["clients"], status, client_id, start, end)
    return relabel(rows.orderBy(F.desc("date"), "id"), {
        "Delivery Number": "number", "Date": "date", "Due Date": "due_date",
        "Client Name": "client_name", "Client Legal Name": "client_legal_name",
        "Delivery Method": "delivery_method", "Status": "status", "Signed": yes_no("is_signed"),
        "Notes": "notes", "Created At": "created_at",
    })


def export_clients(t: Tables, search: str | None = None, indexes: Indexes = {}) -> DataFrame:
    rows = search_any(t["clients"], ["name", "legal_name", "mb", "pib"], search, indexes.get("clients"))
    return relabel(rows.orderBy("name", "id"), {
        "Name": "name", "Legal Name": "legal_name", "MB": "mb", "PIB": "pib", "Address": "address",
        "City": "city", "Municipality": "municipality", "Contact Person": "contact_person",
        "Phone": "phone", "Email": "email", "Telegram": "telegram", "Instagram": "instagram",
        "Installment Payment": yes_no("installment_payment"), "Installment Term": "installment_term",
        "Showcase": yes_no("showcase"), "Bar": yes_no("bar"), "Notes": "notes",
        "Created At": "created_at",
    })


def export_products(
    t: Tables, search: str | None = None, category: str | None = None, only_active: bool = False, indexes: Indexes = {},
) -> DataFrame:
    found = search_any(t["products"], ["name", "code"], search, indexes.get("products"))
    rows = where_all(found, category=category or None)
    return relabel(active_only(rows, only_active).orderBy("name", "id"), {
        "Code": "code", "Name": "name", "Price": "price", "Weight (g)": "weight",
        "Category": "category", "Description": "description", "Status": active_label("is_active"),
        "Created At": "created_at",
    })


def export_product_groups(t: Tables, chunk: int = 10_000) -> DataFrame:
    """Groups, newest first, with their product names in order, joined by '; '.

    A group with more than ``chunk`` products goes on in rows with Part 2, 3, ..., so no cell is unbounded.
    """
    groups, bridge = t["product_groups"], t["product_group_items"]
    members = with_product(bridge.select(F.col("group_id").alias("id"), "product_id"), t["products"],
                           {"name": "product_name"})
    members = members.filter(F.col("product_name") != "")
    names = nest(members, ["id"], ["product_name", "product_id"], [F.col("product_name")], "_names", chunk)
    joined = F.array_join(F.transform("_names", lambda e: e["product_name"]), "; ")
    names = names.select("id", "part", joined.alias("_list"))
    rows = groups.join(names, "id", "left").orderBy(*[s.order() for s in newest_first("id", "part")])
    return relabel(rows, {
        "Group Name": "name", "Quantity Type": "quantity_type", "Original Quantity": "original_quantity",
        "Current Quantity": "current_quantity", "Shipment Date": "shipment_date",
        "Reservation Type": "reservation_type", "Reservation Amount": "reservation_amount",
        "Part": F.coalesce("part", F.lit(1)), "Products": F.coalesce("_list", F.lit("")), "Created At": "created_at",
    })


def export_logs(
    t: Tables, user_id: object | None = None, entity_type: str | None = None,
    action: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
    search: str | None = None, cap: int | None = None,
) -> DataFrame:
    """Log rows in printed form, newest first: all that meet the filters, or the newest ``cap``."""
    if cap is None:
        found = logs_found(t, user_id, entity_type, action, start, end, search)
        rows = named_logs(found, t["users"]).orderBy(*[s.order() for s in newest_first()])
    else:
        rows = list_logs(t, user_id, entity_type, action, start, end, search, limit=cap, most=cap)
    return relabel(rows, {
        "Date": iso_utc("created_at"), "User": F.coalesce(F.nullif(F.col("username"), F.lit("")), F.lit("System")),
        "Action": "action", "Entity Type": "entity_type", "Entity ID": "entity_id",
        "IP Address": "ip_address", "Details": F.coalesce("details", F.lit("{}")),
    })
