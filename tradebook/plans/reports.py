"""Lists and details. ``t`` maps table names to DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.operators.joins import (
    group_products, logged_users, with_client, with_counts, with_product, with_user,
)
from tradebook.operators.ordered import nest
from tradebook.operators.postings import FEW, Postings, among, candidates
from tradebook.operators.search import (
    Sort, active_only, after_key, between_dates, by_ids, like_pattern, newest_first, non_blank, page_of, search_any, sorted_by,
    where_all,
)

Tables = Mapping[str, DataFrame]
# Postings by table, for searches; a table without any is scanned.
Indexes = Mapping[str, Postings]
# The columns each table is searched in.
SEARCHED = {
    "invoices": ("number",), "deliveries": ("number",), "clients": ("name", "legal_name", "mb", "pib"),
    "products": ("name", "code"), "activity_logs": ("action",),
}
# Sort value and id of the last row a reader has seen.
Cursor = tuple[object, object]

INVOICE_LIST = (
    "id", "number", "date", "due_date", "subtotal", "vat_amount", "total", "status",
    "is_delivered", "is_paid", "reference", "notes", "created_at", "updated_at",
    "client_name", "client_legal_name", "item_count",
)
DELIVERY_LIST = (
    "id", "number", "date", "due_date", "delivery_method", "status", "is_signed", "notes",
    "created_at", "updated_at", "client_name", "client_legal_name", "item_count",
)
CLIENT_FIELDS = (
    "id", "name", "legal_name", "mb", "pib", "address", "city", "municipality", "street",
    "house_number", "google_maps_link", "contact_person", "contact", "bank_info",
    "is_manual_address", "telegram", "instagram", "phone", "email", "installment_payment",
    "installment_term", "showcase", "bar", "notes", "created_at", "updated_at",
)
PRODUCT_FIELDS = (
    "id", "code", "name", "price", "weight", "category", "description", "is_active",
    "created_at", "updated_at",
)
LOG_FIELDS = (
    "id", "action", "entity_type", "entity_id", "details", "ip_address", "user_agent",
    "created_at", "username", "full_name",
)
USER_FIELDS = (
    "id", "username", "email", "full_name", "role", "is_active", "permissions", "created_at",
)
GROUP_FIELDS = (
    "id", "name", "quantity_type", "original_quantity", "current_quantity", "shipment_date",
    "reservation_type", "reservation_amount", "created_at", "updated_at",
)
CLIENT_OF_DOCUMENT = {
    "name": "client_name", "legal_name": "client_legal_name", "address": "client_address",
    "mb": "client_mb", "pib": "client_pib",
}


def by_name(collation: str | None) -> list[Sort]:
    return [Sort(F.col("name") if collation is None else F.collate("name", collation)), Sort(F.col("id"))]


def _documents_near(headers: DataFrame, pattern: str, numbers: Postings, clients: Postings) -> DataFrame:
    """A superset of the documents whose number or client's name meets ``pattern``, by the postings of both."""
    by_number, by_client = candidates(numbers, ["number"], pattern), candidates(clients, ["name"], pattern)
    if by_number is None or by_client is None:
        return headers
    (ids, n), (owners, m) = by_number, by_client
    if max(n, m) <= FEW:
        named = [F.col(c).isin([r[0] for r in found.collect()]) for c, found in (("id", ids), ("client_id", owners))]
        return headers.filter(named[0] | named[1])
    owned = among(headers.select("id", "client_id"), owners, m, "client_id").select(F.col("id").alias("key"))
    return headers.join(ids.unionByName(owned).distinct().withColumnRenamed("key", "id"), "id", "left_semi")


def documents_found(
    headers: DataFrame, clients: DataFrame, search: str | None = None,
    status: str | None = None, client_id: object | None = None,
    numbers: Postings | None = None, names: Postings | None = None,
) -> DataFrame:
    """Invoices or deliveries with client names that meet the list filters; also the base of the
    page count. ``numbers`` and ``names``: postings of the headers and of the clients."""
    picked = where_all(headers, status=status, client_id=client_id)
    if search and numbers is not None and names is not None:
        picked = _documents_near(picked, like_pattern(search), numbers, names)
    named = with_client(picked, clients, {"name": "client_name", "legal_name": "client_legal_name"})
    return search_any(named, ["number", "client_name"], search)


def _after(df: DataFrame, after: Cursor | None, column: str = "created_at", descending: bool = True) -> DataFrame:
    return df if after is None else after_key(df, column, after[0], "id", after[1], descending)


def _document_page(
    t: Tables, table: str, items: str, key: str, fields: Iterable[str], search: str | None,
    status: str | None, client_id: object | None, page: int, limit: int, after: Cursor | None, indexes: Indexes,
) -> DataFrame:
    """Take the page first, then count lines of its at most 100 documents only.

    Without a search the page is cut on the headers alone: every document has a client, so the
    join with clients neither drops nor adds one.
    """
    if search:
        near = indexes.get(table), indexes.get("clients")
        found = _after(documents_found(t[table], t["clients"], search, status, client_id, *near), after)
        rows = page_of(found, newest_first(), page, limit)
    else:
        heads = _after(where_all(t[table], status=status, client_id=client_id), after)
        names = {"name": "client_name", "legal_name": "client_legal_name"}
        rows = with_client(page_of(heads, newest_first(), page, limit), t["clients"], names)
    ids = F.broadcast(rows.select(F.col("id").alias(key)))  # at most 100 rows
    lines = t[items].select(key).join(ids, key, "left_semi")
    return sorted_by(with_counts(rows, lines, key).select(*fields), newest_first())


def list_invoices(
    t: Tables, search: str | None = None, status: str | None = None,
    client_id: object | None = None, page: int = 1, limit: int = 50, after: Cursor | None = None, indexes: Indexes = {},
) -> DataFrame:
    """``after``: (created_at, id) of the last row seen; the page then counts from there."""
    return _document_page(t, "invoices", "invoice_items", "invoice_id", INVOICE_LIST,
                          search, status, client_id, page, limit, after, indexes)


def list_deliveries(
    t: Tables, search: str | None = None, status: str | None = None,
    client_id: object | None = None, page: int = 1, limit: int = 50, after: Cursor | None = None, indexes: Indexes = {},
) -> DataFrame:
    return _document_page(t, "deliveries", "delivery_items", "delivery_id", DELIVERY_LIST,
                          search, status, client_id, page, limit, after, indexes)


def clients_found(t: Tables, search: str | None = None, indexes: Indexes = {}) -> DataFrame:
    return search_any(t["clients"].select(*CLIENT_FIELDS), ["name", "mb", "pib"], search, indexes.get("clients"))


def list_clients(
    t: Tables, search: str | None = None, page: int = 1, limit: int = 50, collation: str | None = None,
    after: Cursor | None = None, indexes: Indexes = {},
) -> DataFrame:
    """``after``: (name, id) of the last row seen, in the order without a collation."""
    return page_of(_after(clients_found(t, search, indexes), after, "name", False), by_name(collation), page, limit)


def client_detail(t: Tables, ids: Iterable | DataFrame) -> DataFrame:
    return by_ids(t["clients"].select(*CLIENT_FIELDS), ids)


def products_found(
    t: Tables, search: str | None = None, category: str | None = None, only_active: bool = False, indexes: Indexes = {},
) -> DataFrame:
    found = search_any(t["products"].select(*PRODUCT_FIELDS), ["name", "code"], search, indexes.get("products"))
    return active_only(where_all(found, category=category or None), only_active)


def list_products(
    t: Tables, search: str | None = None, category: str | None = None, only_active: bool = False,
    page: int = 1, limit: int = 50, collation: str | None = None, after: Cursor | None = None, indexes: Indexes = {},
) -> DataFrame:
    found = products_found(t, search, category, only_active, indexes)
    return page_of(_after(found, after, "name", False), by_name(collation), page, limit)


def product_detail(t: Tables, ids: Iterable | DataFrame) -> DataFrame:
    return by_ids(t["products"].select(*PRODUCT_FIELDS), ids)


def product_categories(t: Tables) -> DataFrame:
    used = non_blank(active_only(t["products"]), "category")
    return used.select("category").distinct().orderBy("category")


def logs_found(
    t: Tables, user_id: object | None = None, entity_type: str | None = None,
    action: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
    search: str | None = None, indexes: Indexes = {},
) -> DataFrame:
    """Log rows meeting the filters. User names are joined here only when the search reads them.

    ``indexes`` serve ``action``; ``search`` also looks at user names, which most rows share, and scans.
    """
    logs = where_all(t["activity_logs"], user_id=user_id, entity_type=entity_type)
    logs = between_dates(search_any(logs, ["action"], action, indexes.get("activity_logs")), "created_at", start, end)
    if not search:
        return logs
    return search_any(with_user(logs, t["users"]), ["action", "username"], search)


def named_logs(logs: DataFrame, users: DataFrame) -> DataFrame:
    named = logs if "username" in logs.columns else with_user(logs, users)
    return named.select(*LOG_FIELDS)


def list_logs(
    t: Tables, user_id: object | None = None, entity_type: str | None = None,
    action: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
    search: str | None = None, page: int = 1, limit: int = 50, parsed: bool = False,
    most: int = 100, after: Cursor | None = None, indexes: Indexes = {},
) -> DataFrame:
    """Newest rows with user names. ``parsed`` turns the JSON details into a variant value.

    The user join keeps every row, so without a search the page is cut before it.
    """
    found = _after(logs_found(t, user_id, entity_type, action, start, end, search, indexes), after)
    rows = named_logs(page_of(found, newest_first(), page, limit, most), t["users"])
    if parsed:
        rows = rows.withColumn("details", F.try_parse_json("details"))
    return sorted_by(rows, newest_first())


def log_entity_types(t: Tables) -> DataFrame:
    kinds = t["activity_logs"].select("entity_type").filter("entity_type IS NOT NULL")
    return kinds.distinct().orderBy("entity_type")


def log_users(t: Tables) -> DataFrame:
    seen = logged_users(t["users"], t["activity_logs"])
    return seen.select("id", "username", "full_name").orderBy("username")


def list_users(t: Tables) -> DataFrame:
    return sorted_by(t["users"].select(*USER_FIELDS), newest_first())


def group_members(t: Tables, ids: Iterable | DataFrame | None = None) -> DataFrame:
    """One row per group and product, product columns NULL for an empty group."""
    groups = by_ids(t["product_groups"].select(*GROUP_FIELDS), ids)
    return group_products(groups, t["product_group_items"], t["products"])


def list_groups(
    t: Tables, ids: Iterable | DataFrame | None = None, chunk: int = 10_000
) -> DataFrame:
    """Groups, newest first, with an array of {id, code, name, weight, price}, empty if none.

    A group with more than ``chunk`` products goes on in rows with part 2, 3, ...
    """
    groups = by_ids(t["product_groups"].select(*GROUP_FIELDS), ids)
    members = t["product_group_items"].select("group_id", "product_id").join(
        groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    listed = with_product(members, t["products"], {c: c for c in ("code", "name", "weight", "price")})
    fields = [F.col("product_id").alias("id"), *map(F.col, ("code", "name", "weight", "price"))]
    nested = nest(listed, ["group_id"], ["product_id"], fields, "products", chunk)
    nested = nested.withColumnRenamed("group_id", "id")
    empty = F.array().cast(nested.schema["products"].dataType)
    return (
        groups.join(nested, "id", "left")
        .select(*GROUP_FIELDS, F.coalesce("part", F.lit(1)).alias("part"),
                F.coalesce("products", empty).alias("products"))
        .orderBy(*[s.order() for s in newest_first("id", "part")])
    )


def group_detail(t: Tables, ids: Iterable | DataFrame, chunk: int = 10_000) -> DataFrame:
    return list_groups(t, ids, chunk)


INVOICE_DETAIL = (
    "id", "number", "date", "due_date", "delivery_address", "vat_rate", "subtotal", "vat_amount",
    "total", "status", "is_delivered", "is_paid", "reference", "notes", "created_at", "updated_at",
    "client_id", *CLIENT_OF_DOCUMENT.values(),
)
DELIVERY_DETAIL = (
    "id", "number", "date", "due_date", "delivery_method", "status", "is_signed", "notes",
    "created_at", "updated_at", "client_id", *CLIENT_OF_DOCUMENT.values(),
)
PRODUCT_OF_LINE = {"code": "product_code", "name": "product_name", "weight": "product_weight"}


def _detail(
    t: Tables, table: str, items: str, key: str, fields: Iterable[str], amounts: Iterable[str],
    ids: Iterable | DataFrame | None,
) -> DataFrame:
    headers = with_client(by_ids(t[table], ids), t["clients"], CLIENT_OF_DOCUMENT).select(*fields)
    lines = by_ids(t[items], ids, key)
    lines = with_product(lines, t["products"], PRODUCT_OF_LINE).select(
        F.col(key).alias("id"), F.col("id").alias("item_id"),
        F.col("created_at").alias("item_created_at"), "product_id",
        *PRODUCT_OF_LINE.values(), *amounts,
    )
    return headers.join(lines, "id", "left")


def _in_each(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of one header together and in ``order``: the join leaves all rows of a header, which is unique, in one
    partition, so they are sorted where they are, without a shuffle of the lines."""
    return rows.sortWithinPartitions(*order)


def invoice_detail(t: Tables, ids: Iterable | DataFrame | None = None) -> DataFrame:
    """Header and client fields repeated on one row per item; an invoice's rows follow each other by creation time.

    An invoice without items has one row with NULL item columns.
    """
    rows = _detail(t, "invoices", "invoice_items", "invoice_id", INVOICE_DETAIL,
                   ("quantity", "unit_price", "total_price"), ids)
    return _in_each(rows, "id", "item_created_at", "item_id")


def delivery_detail(t: Tables, ids: Iterable | DataFrame | None = None) -> DataFrame:
    rows = _detail(t, "deliveries", "delivery_items", "delivery_id", DELIVERY_DETAIL,
                   ("quantity", "unit"), ids)
    return _in_each(rows, "id", "item_created_at", "item_id")


def invoice_documents(
    t: Tables, ids: Iterable | DataFrame | None = None, chunk: int = 10_000
) -> DataFrame:
    """Invoices with an array of items in creation order; long ones continue in further parts."""
    rows = _detail(t, "invoices", "invoice_items", "invoice_id", ("id",),
                   ("quantity", "unit_price", "total_price"), ids).filter("item_id IS NOT NULL")
    fields = [F.col("item_id").alias("id"), F.col("product_id"), F.col("product_code"),
              F.col("product_name"), F.col("product_weight"), F.col("quantity"),
              F.col("unit_price"), F.col("total_price")]
    return _documents(t, "invoices", "invoice_items", "invoice_id", INVOICE_DETAIL, rows, fields, ids, chunk)


def delivery_documents(
    t: Tables, ids: Iterable | DataFrame | None = None, chunk: int = 10_000
) -> DataFrame:
    rows = _detail(t, "deliveries", "delivery_items", "delivery_id", ("id",),
                   ("quantity", "unit"), ids).filter("item_id IS NOT NULL")
    fields = [F.col("item_id").alias("id"), F.col("product_id"), F.col("product_code"),
              F.col("product_name"), F.col("product_weight"), F.col("quantity"), F.col("unit")]
    return _documents(t, "deliveries", "delivery_items", "delivery_id", DELIVERY_DETAIL, rows, fields, ids, chunk)


def _documents(
    t: Tables, table: str, items: str, key: str, header: Iterable[str], rows: DataFrame, fields: list[Column],
    ids: Iterable | DataFrame | None, chunk: int,
) -> DataFrame:
    lines = by_ids(t[items], ids, key).select(F.col(key).alias("id"))
    nested = nest(rows, ["id"], ["item_created_at", "item_id"], fields, "items", chunk, counted=lines, by=())
    heads = with_client(by_ids(t[table], ids), t["clients"], CLIENT_OF_DOCUMENT).select(*header)
    empty = F.array().cast(nested.schema["items"].dataType)
    return heads.join(nested, "id", "left").select(
        *header, F.coalesce("part", F.lit(1)).alias("part"),
        F.coalesce("items", empty).alias("items"),
    ).sortWithinPartitions("id", "part")


def client_invoices(t: Tables, ids: Iterable | DataFrame | None = None) -> DataFrame:
    """Invoices of each client with line counts, latest first inside a client."""
    heads = by_ids(t["invoices"].select(
        "client_id", "id", "number", "date", "due_date", "total", "status", "is_delivered", "is_paid"
    ), ids, "client_id")
    return with_counts(heads, t["invoice_items"], "invoice_id").orderBy(
        "client_id", F.desc("date"), "id")


def client_deliveries(t: Tables, ids: Iterable | DataFrame | None = None) -> DataFrame:
    heads = by_ids(t["deliveries"].select(
        "client_id", "id", "number", "date", "due_date", "delivery_method", "status", "is_signed"
    ), ids, "client_id")
    return with_counts(heads, t["delivery_items"], "delivery_id").orderBy(
        "client_id", F.desc("date"), "id")
