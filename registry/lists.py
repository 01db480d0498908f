"""Registered queries: predicates, joins, lists and details."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.book import register
from tradebook.functions.expressions import active_label, yes_no
from tradebook.operators import joins, merge, search
from tradebook.plans import reports

AS_OF = dt.date(2001, 5, 20)
VIEWER = 7

# --- predicates and projections

register(
    "search_any", lambda d: search.search_any(d.clients.select("id", "name", "mb", "pib"), ["name", "mb", "pib"], "r#0%12"),
    "SELECT id, name, mb, pib FROM clients WHERE name ILIKE '%r#0%12%' OR mb ILIKE '%r#0%12%' OR pib ILIKE '%r#0%12%'",
)
register(
    "where_all", lambda d: search.where_all(d.invoices.select("id", "status", "is_paid"), status="draft", is_paid=True, client_id=None),
    "SELECT id, status, is_paid FROM invoices WHERE status = 'draft' AND is_paid = true",
)
register(
    "between_dates", lambda d: search.between_dates(d.invoices.select("id", "date"), "date", dt.date(1996, 1, 1), dt.date(1996, 6, 30)),
    "SELECT id, date FROM invoices WHERE date >= DATE '1996-01-01' AND date <= DATE '1996-06-30'",
)
for _period in ("month", "quarter", "year"):
    register(
        f"in_period_{_period}",
        lambda d, p=_period: search.in_period(d.invoices.select("id", "date"), "date", p, AS_OF),
        f"SELECT id, date FROM invoices WHERE date >= date_trunc('{_period}', DATE '2001-05-20')",
    )
register(
    "active_only", lambda d: search.active_only(d.products.select("id", "code", "is_active")),
    "SELECT id, code, is_active FROM products WHERE is_active = true",
)
register(
    "non_blank", lambda d: search.non_blank(d.products.select("id", "category"), "category"),
    "SELECT id, category FROM products WHERE category IS NOT NULL AND category <> ''",
)
register(
    "by_ids", lambda d: search.by_ids(d.invoices.select("id", "number"), d.status_requests.select("id")),
    "SELECT id, number FROM invoices WHERE id IN (SELECT id FROM status_requests)",
)
register(
    "missing_ids", lambda d: search.missing_ids(d.invoices, d.status_requests.select("id")),
    "SELECT DISTINCT id FROM status_requests WHERE id NOT IN (SELECT id FROM invoices)",
)
register(
    "visible_logs_own", lambda d: search.visible_logs(d.activity_logs.select("id", "user_id", "action"), VIEWER, "user"),
    f"SELECT id, user_id, action FROM activity_logs WHERE user_id = {VIEWER}",
)
register(
    "visible_logs_admin", lambda d: search.visible_logs(d.activity_logs.select("id", "user_id", "action"), 50, "admin"),
    "SELECT id, user_id, action FROM activity_logs",
)
register(
    "visible_log_counts", lambda d: search.visible_log_counts(d.activity_logs, d.users),
    """SELECT u.id, u.username, u.role,
              CASE WHEN u.role = 'admin' THEN (SELECT count(*) FROM activity_logs)
                   ELSE (SELECT count(*) FROM activity_logs l WHERE l.user_id = u.id) END AS visible
       FROM users u""",
)
register(
    "granted_statistics", lambda d: search.granted(d.users, "statistics").select("id", "username"),
    """SELECT id, username FROM users
       WHERE is_active AND (role = 'admin' OR json_extract_string(permissions, '$.statistics') = 'true')""",
)
register(
    "granted_all", lambda d: search.granted_all(d.users).select("id", "permission"),
    """SELECT u.id, p.permission FROM users u
       CROSS JOIN (SELECT unnest(['clients', 'products', 'invoices', 'deliveries', 'statistics', 'warehouse', 'editUser']) AS permission) p
       WHERE u.is_active AND (u.role = 'admin' OR json_extract_string(u.permissions, '$.' || p.permission) = 'true')""",
)
register(
    "relabel", lambda d: search.relabel(d.products, {"Code": "code", "Unit Price": "price"}),
    'SELECT code AS "Code", price AS "Unit Price" FROM products',
)
register(
    "flag_labels", lambda d: d.invoices.select(
        "id", yes_no("is_paid").alias("paid"), yes_no(F.nullif("is_delivered", F.lit(False))).alias("delivered"),
        active_label("is_delivered").alias("state")),
    """SELECT id, CASE WHEN is_paid THEN 'Yes' ELSE 'No' END AS paid, CASE WHEN is_delivered THEN 'Yes' ELSE 'No' END AS delivered,
              CASE WHEN is_delivered THEN 'Active' ELSE 'Inactive' END AS state FROM invoices""",
)
register(
    "top_k", lambda d: search.top_k(d.invoices.select("id", "total"), "total", ["id"], 25),
    "SELECT id, total FROM invoices ORDER BY total DESC, id LIMIT 25",
)
register(
    "page_of", lambda d: search.page_of(d.invoices.select("id", "created_at"), search.newest_first(), 3, 100),
    "SELECT id, created_at FROM invoices ORDER BY created_at DESC NULLS FIRST, id LIMIT 100 OFFSET 200",
)
_PAGE_INFO = """SELECT {page} AS page, {limit} AS "limit", count(*) AS total, cast(ceil(count(*) / {limit}.0) AS bigint) AS "totalPages",
    {page} < ceil(count(*) / {limit}.0) AS "hasNext", {page} > 1 AS "hasPrev" FROM """
register(
    "page_info_invoices",
    lambda d: search.page_info(reports.documents_found(d.invoices, d.clients, "inv-0000", "confirmed"), 3, 50),
    _PAGE_INFO.format(page=3, limit=50)
    + "invoices i JOIN clients c ON i.client_id = c.id WHERE (i.number ILIKE '%inv-0000%' OR c.name ILIKE '%inv-0000%') AND i.status = 'confirmed'",
)
register(
    "page_info_logs", lambda d: search.page_info(reports.logs_found(d, entity_type="invoice", search="user_1"), 1, 100),
    _PAGE_INFO.format(page=1, limit=100)
    + "activity_logs l LEFT JOIN users u ON l.user_id = u.id WHERE l.entity_type = 'invoice' AND (l.action ILIKE '%user_1%' OR u.username ILIKE '%user_1%')",
)

# --- joins

_NAMES = {"name": "client_name", "legal_name": "client_legal_name"}
register(
    "join_invoices_clients", lambda d: joins.with_client(d.invoices, d.clients, _NAMES).select("id", "number", "client_id", "client_name"),
    "SELECT i.id, i.number, i.client_id, c.name AS client_name FROM invoices i JOIN clients c ON i.client_id = c.id",
)
register(
    "join_deliveries_clients", lambda d: joins.with_client(d.deliveries, d.clients, _NAMES).select("id", "number", "client_id", "client_name"),
    "SELECT i.id, i.number, i.client_id, c.name AS client_name FROM deliveries i JOIN clients c ON i.client_id = c.id",
)
register(
    "join_invoice_counts", lambda d: joins.with_counts(d.invoices.select("id"), d.invoice_items, "invoice_id"),
    "SELECT i.id, count(l.id) AS item_count FROM invoices i LEFT JOIN invoice_items l ON l.invoice_id = i.id GROUP BY i.id",
)
register(
    "join_delivery_counts", lambda d: joins.with_counts(d.deliveries.select("id"), d.delivery_items, "delivery_id"),
    "SELECT i.id, count(l.id) AS item_count FROM deliveries i LEFT JOIN delivery_items l ON l.delivery_id = i.id GROUP BY i.id",
)
register(
    "join_items_products", lambda d: joins.with_product(d.invoice_items, d.products, {"code": "product_code", "weight": "product_weight"})
    .select("id", "product_id", "product_code", "product_weight", "quantity"),
    """SELECT l.id, l.product_id, p.code AS product_code, p.weight AS product_weight, l.quantity
       FROM invoice_items l JOIN products p ON l.product_id = p.id""",
)
register(
    "join_group_products", lambda d: joins.group_products(d.product_groups, d.product_group_items, d.products)
    .select("id", "name", "product_id", "product_code", "product_weight"),
    """SELECT g.id, g.name, b.product_id, p.code AS product_code, p.weight AS product_weight FROM product_groups g
       LEFT JOIN product_group_items b ON g.id = b.group_id LEFT JOIN products p ON b.product_id = p.id""",
)
register(
    "join_product_group", lambda d: joins.product_group(d.product_group_items, d.product_groups),
    "SELECT b.product_id, min(g.id) AS group_id FROM product_group_items b JOIN product_groups g ON b.group_id = g.id GROUP BY b.product_id",
)
register(
    "join_logs_users", lambda d: joins.with_user(d.activity_logs, d.users).select("id", "user_id", "action", "username"),
    "SELECT l.id, l.user_id, l.action, u.username FROM activity_logs l LEFT JOIN users u ON l.user_id = u.id",
)
register(
    "join_client_products", lambda d: joins.client_product_lines(d.invoice_items, d.invoices)
    .groupBy("client_id", "product_id").agg(F.sum("quantity").alias("quantity")),
    """SELECT i.client_id, l.product_id, cast(sum(l.quantity) AS bigint) AS quantity
       FROM products p JOIN invoice_items l ON p.id = l.product_id JOIN invoices i ON l.invoice_id = i.id GROUP BY i.client_id, l.product_id""",
)
register(
    "taken_numbers", lambda d: merge.taken(d.invoice_requests, d.invoices, ["number"]),
    "SELECT request_id FROM invoice_requests WHERE number IN (SELECT number FROM invoices)",
)
register(
    "taken_mb_or_pib", lambda d: merge.taken(d.client_requests, d.clients, ["mb", "pib"]),
    "SELECT request_id FROM client_requests WHERE mb IN (SELECT mb FROM clients) OR pib IN (SELECT pib FROM clients)",
)
register(
    "taken_username_or_email", lambda d: merge.taken(d.user_requests, d.users, ["username", "email"]),
    """SELECT request_id FROM user_requests WHERE username IN (SELECT username FROM users)
       OR email IN (SELECT email FROM users WHERE email IS NOT NULL)""",
)

# --- lists

register(
    "list_invoices", lambda d: reports.list_invoices(d, "r#00000", "confirmed", page=2, limit=50),
    """SELECT i.id, i.number, i.date, i.due_date, i.subtotal, i.vat_amount, i.total, i.status, i.is_delivered, i.is_paid,
              cast(NULL AS varchar) AS reference, i.notes, i.created_at, cast(NULL AS timestamp) AS updated_at,
              c.name AS client_name, c.legal_name AS client_legal_name, count(l.id) AS item_count
       FROM invoices i JOIN clients c ON i.client_id = c.id LEFT JOIN invoice_items l ON l.invoice_id = i.id
       WHERE (i.number ILIKE '%r#00000%' OR c.name ILIKE '%r#00000%') AND i.status = 'confirmed'
       GROUP BY ALL ORDER BY i.created_at DESC NULLS FIRST, i.id LIMIT 50 OFFSET 50""",
)
register(
    "list_deliveries", lambda d: reports.list_deliveries(d, None, "draft", page=1, limit=100),
    """SELECT i.id, i.number, i.date, i.due_date, i.delivery_method, i.status, i.is_signed, i.notes, i.created_at,
              cast(NULL AS timestamp) AS updated_at, c.name AS client_name, c.legal_name AS client_legal_name, count(l.id) AS item_count
       FROM deliveries i JOIN clients c ON i.client_id = c.id LEFT JOIN delivery_items l ON l.delivery_id = i.id
       WHERE i.status = 'draft' GROUP BY ALL ORDER BY i.created_at DESC NULLS FIRST, i.id LIMIT 100""",
)


def nulls(kind: str, *names: str) -> str:
    """Typed NULL columns the views lack."""
    return ", ".join(f"cast(NULL AS {kind}) AS {n}" for n in names)


CLIENT_SQL = f"""id, name, legal_name, mb, pib, address, city, municipality, email, installment_payment, installment_term,
    showcase, bar, cast(NULL AS boolean) AS is_manual_address, {nulls('timestamp', 'created_at', 'updated_at')},
    {nulls('varchar', 'street', 'house_number', 'google_maps_link', 'contact_person', 'contact', 'bank_info', 'telegram',
           'instagram', 'phone', 'notes')}"""
PRODUCT_SQL = f"""id, code, name, price, weight, category, is_active, cast(NULL AS varchar) AS description,
    {nulls('timestamp', 'created_at', 'updated_at')}"""

register(
    "list_clients", lambda d: reports.list_clients(d, "00000001", 1, 100),
    f"""SELECT {CLIENT_SQL} FROM clients
        WHERE name ILIKE '%00000001%' OR mb ILIKE '%00000001%' OR pib ILIKE '%00000001%' ORDER BY name, id LIMIT 100""",
)
register(
    "client_detail", lambda d: reports.client_detail(d, d.client_requests.select("request_id")),
    f"SELECT {CLIENT_SQL} FROM clients WHERE id IN (SELECT request_id FROM client_requests)",
)
register(
    "list_products", lambda d: reports.list_products(d, "bolt", "SMALL", True, 1, 50),
    f"""SELECT {PRODUCT_SQL} FROM products
        WHERE (name ILIKE '%bolt%' OR code ILIKE '%bolt%') AND category = 'SMALL' AND is_active ORDER BY name, id LIMIT 50""",
)
register(
    "product_detail", lambda d: reports.product_detail(d, d.product_requests.select("request_id")),
    f"SELECT {PRODUCT_SQL} FROM products WHERE id IN (SELECT request_id FROM product_requests)",
)
_LOG_SQL = """l.id, l.action, l.entity_type, l.entity_id, l.details, l.ip_address, cast(NULL AS varchar) AS user_agent,
    l.created_at, u.username, u.full_name"""
register(
    "list_logs", lambda d: reports.list_logs(d, entity_type="invoice", page=2, limit=100),
    f"""SELECT {_LOG_SQL} FROM activity_logs l LEFT JOIN users u ON l.user_id = u.id
        WHERE l.entity_type = 'invoice' ORDER BY l.created_at DESC NULLS FIRST, l.id LIMIT 100 OFFSET 100""",
)
register(
    "list_logs_search",
    lambda d: reports.list_logs(d, action="view", start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 20), search="USER_1", limit=100),
    f"""SELECT {_LOG_SQL} FROM activity_logs l LEFT JOIN users u ON l.user_id = u.id
        WHERE l.action ILIKE '%view%' AND l.created_at >= TIMESTAMP '2024-01-05' AND l.created_at <= TIMESTAMP '2024-01-20'
          AND (l.action ILIKE '%USER_1%' OR u.username ILIKE '%USER_1%')
        ORDER BY l.created_at DESC NULLS FIRST, l.id LIMIT 100""",
)
_GROUP_SQL = """g.id, g.name, g.quantity_type, g.original_quantity, g.current_quantity, g.shipment_date, g.reservation_type,
    g.reservation_amount, g.created_at, cast(NULL AS timestamp) AS updated_at"""


def _joined_products(df):
    text = F.transform("products", lambda p: F.concat_ws("|", p["id"], p["code"], p["name"], p["weight"], p["price"]))
    return df.withColumn("products", F.array_join(text, ";"))


register(
    "list_groups", lambda d: _joined_products(reports.list_groups(d)),
    f"""SELECT {_GROUP_SQL}, 1 AS part, coalesce(string_agg(concat_ws('|', p.id, p.code, p.name, p.weight, p.price), ';' ORDER BY p.id), '') AS products
        FROM product_groups g LEFT JOIN product_group_items b ON g.id = b.group_id LEFT JOIN products p ON b.product_id = p.id
        GROUP BY ALL""",
)
register(
    "group_members", lambda d: reports.group_members(d),
    f"""SELECT {_GROUP_SQL}, b.product_id, p.code AS product_code, p.name AS product_name, p.weight AS product_weight, p.price AS product_price
        FROM product_groups g LEFT JOIN product_group_items b ON g.id = b.group_id LEFT JOIN products p ON b.product_id = p.id""",
)
register(
    "group_detail", lambda d: _joined_products(reports.group_detail(d, d.group_product_requests.select("group_id"))).drop("created_at", "updated_at"),
    """SELECT g.id, g.name, g.quantity_type, g.original_quantity, g.current_quantity, g.shipment_date, g.reservation_type,
              g.reservation_amount, 1 AS part, coalesce(string_agg(concat_ws('|', p.id, p.code, p.name, p.weight, p.price), ';' ORDER BY p.id), '') AS products
       FROM product_groups g LEFT JOIN product_group_items b ON g.id = b.group_id LEFT JOIN products p ON b.product_id = p.id
       WHERE g.id IN (SELECT group_id FROM group_product_requests) GROUP BY ALL""",
)
register(
    "list_users", lambda d: reports.list_users(d),
    "SELECT id, username, email, full_name, role, is_active, permissions, cast(NULL AS timestamp) AS created_at FROM users",
)
_CLIENT_OF = "c.name AS client_name, c.legal_name AS client_legal_name, c.address AS client_address, c.mb AS client_mb, c.pib AS client_pib"
_LINE_OF = """l.id AS item_id, l.created_at AS item_created_at, l.product_id, p.code AS product_code, p.name AS product_name,
    p.weight AS product_weight, l.quantity"""
_INVOICE_HEAD = f"""i.id, i.number, i.date, i.due_date, {nulls('varchar', 'delivery_address', 'reference')}, i.vat_rate, i.subtotal, i.vat_amount,
    i.total, i.status, i.is_delivered, i.is_paid, i.notes, i.created_at, cast(NULL AS timestamp) AS updated_at, i.client_id, {_CLIENT_OF}"""
register(
    "invoice_detail", lambda d: reports.invoice_detail(d),
    f"""SELECT {_INVOICE_HEAD}, {_LINE_OF}, l.unit_price, l.total_price FROM invoices i JOIN clients c ON i.client_id = c.id
        LEFT JOIN invoice_items l ON l.invoice_id = i.id LEFT JOIN products p ON l.product_id = p.id""",
)
register(
    "delivery_detail", lambda d: reports.delivery_detail(d),
    f"""SELECT i.id, i.number, i.date, i.due_date, i.delivery_method, i.status, i.is_signed, i.notes, i.created_at,
               cast(NULL AS timestamp) AS updated_at, i.client_id, {_CLIENT_OF}, {_LINE_OF}, l.unit
        FROM deliveries i JOIN clients c ON i.client_id = c.id
        LEFT JOIN delivery_items l ON l.delivery_id = i.id LEFT JOIN products p ON l.product_id = p.id""",
)


def _joined_items(df, *fields):
    text = F.transform("items", lambda p: F.concat_ws("|", *[p[f] for f in fields]))
    return df.select("id", "number", "client_name", "part", F.array_join(text, ";").alias("items"))


register(
    "invoice_documents",
    lambda d: _joined_items(reports.invoice_documents(d), "id", "product_code", "quantity", "unit_price", "total_price"),
    """SELECT i.id, i.number, c.name AS client_name, 1 AS part,
              coalesce(string_agg(concat_ws('|', l.id, p.code, l.quantity, l.unit_price, l.total_price), ';' ORDER BY l.created_at, l.id), '') AS items
       FROM invoices i JOIN clients c ON i.client_id = c.id LEFT JOIN invoice_items l ON l.invoice_id = i.id
       LEFT JOIN products p ON l.product_id = p.id GROUP BY ALL""",
)
register(
    "delivery_documents",
    lambda d: _joined_items(reports.delivery_documents(d), "id", "product_code", "quantity", "unit"),
    """SELECT i.id, i.number, c.name AS client_name, 1 AS part,
              coalesce(string_agg(concat_ws('|', l.id, p.code, l.quantity, l.unit), ';' ORDER BY l.created_at, l.id), '') AS items
       FROM deliveries i JOIN clients c ON i.client_id = c.id LEFT JOIN delivery_items l ON l.delivery_id = i.id
       LEFT JOIN products p ON l.product_id = p.id GROUP BY ALL""",
)
register(
    "client_invoices", lambda d: reports.client_invoices(d),
    """SELECT i.client_id, i.id, i.number, i.date, i.due_date, i.total, i.status, i.is_delivered, i.is_paid, count(l.id) AS item_count
       FROM invoices i LEFT JOIN invoice_items l ON l.invoice_id = i.id GROUP BY ALL""",
)
register(
    "client_deliveries", lambda d: reports.client_deliveries(d),
    """SELECT i.client_id, i.id, i.number, i.date, i.due_date, i.delivery_method, i.status, i.is_signed, count(l.id) AS item_count
       FROM deliveries i LEFT JOIN delivery_items l ON l.delivery_id = i.id GROUP BY ALL""",
)
register(
    "product_categories", lambda d: reports.product_categories(d),
    "SELECT DISTINCT category FROM products WHERE category IS NOT NULL AND category <> '' AND is_active",
)
register(
    "log_entity_types", lambda d: reports.log_entity_types(d),
    "SELECT DISTINCT entity_type FROM activity_logs WHERE entity_type IS NOT NULL",
)
register(
    "log_users", lambda d: reports.log_users(d),
    "SELECT DISTINCT u.id, u.username, u.full_name FROM activity_logs l JOIN users u ON l.user_id = u.id",
)
