"""Registered queries: statistics and exports."""

from __future__ import annotations

import datetime as dt
import functools

from registry.book import register
from registry.lists import AS_OF, nulls
from tradebook.plans import export, stats
from tradebook.session import scratch_path
from tradebook.sources.writers import read_csv, write_csv, write_json

_DAY = "DATE '2001-05-20'"


def _statistics_sql(period: str) -> str:
    start, year = f"date_trunc('{period}', {_DAY})", f"date_trunc('year', {_DAY})"
    return f"""
    WITH money AS (
      SELECT client_id, count(*) AS invoice_count, sum(total) AS revenue,
             cast(cast((2 * cast(sum(total) * 100 AS hugeint) + count(*)) // (2 * count(*)) AS decimal(18,0)) / 100 AS decimal(16,2)) AS average
      FROM invoices WHERE status = 'confirmed' AND date >= {start} GROUP BY client_id),
    sold AS (
      SELECT i.client_id, l.product_id, sum(l.quantity) AS q FROM invoice_items l JOIN invoices i ON l.invoice_id = i.id
      WHERE i.status = 'confirmed' AND i.date >= {start} GROUP BY ALL),
    best AS (SELECT client_id, product_id, row_number() OVER (PARTITION BY client_id ORDER BY q DESC, product_id) AS rn FROM sold),
    yearly AS (
      SELECT i.client_id, sum(l.quantity) AS q FROM invoice_items l JOIN invoices i ON l.invoice_id = i.id
      WHERE i.status = 'confirmed' AND i.date >= {year} GROUP BY ALL)
    SELECT c.id AS client_id, coalesce(m.invoice_count, 0) AS invoice_count,
           cast(coalesce(m.average, 0) AS decimal(16,2)) AS average_order_value,
           cast(coalesce(m.revenue, 0) AS decimal(22,2)) AS total_revenue, p.name AS most_popular_product,
           cast(coalesce(y.q, 0) AS bigint) AS annual_consumption, '{period}' AS period
    FROM clients c LEFT JOIN money m ON m.client_id = c.id LEFT JOIN best b ON b.client_id = c.id AND b.rn = 1
    LEFT JOIN products p ON p.id = b.product_id LEFT JOIN yearly y ON y.client_id = c.id"""


for _period in ("month", "quarter", "year"):
    register(f"client_statistics_{_period}", lambda d, p=_period: stats.client_statistics(d, p, AS_OF), _statistics_sql(_period))
register(
    "top_product_per_client", lambda d: stats.top_product_per_client(d, "quarter", AS_OF),
    f"""SELECT client_id, product_id, p.name AS product_name, quantity FROM (
          SELECT i.client_id, l.product_id, cast(sum(l.quantity) AS bigint) AS quantity,
                 row_number() OVER (PARTITION BY i.client_id ORDER BY sum(l.quantity) DESC, l.product_id) AS rn
          FROM invoice_items l JOIN invoices i ON l.invoice_id = i.id
          WHERE i.status = 'confirmed' AND i.date >= date_trunc('quarter', {_DAY}) GROUP BY i.client_id, l.product_id) t
        JOIN products p ON p.id = t.product_id WHERE rn = 1""",
)
register(
    "annual_consumption", lambda d: stats.annual_consumption(d, AS_OF),
    f"""SELECT i.client_id, cast(sum(l.quantity) AS bigint) AS annual_consumption FROM invoice_items l JOIN invoices i ON l.invoice_id = i.id
        WHERE i.status = 'confirmed' AND i.date >= date_trunc('year', {_DAY}) GROUP BY ALL""",
)
register(
    "product_stats", lambda d: stats.product_stats(d),
    """SELECT p.id, p.code, p.name, coalesce(s.n, 0) AS invoice_count, coalesce(v.n, 0) AS delivery_count,
              cast(coalesce(s.q, 0) AS bigint) AS total_sold_quantity, cast(coalesce(s.r, 0) AS decimal(28,2)) AS total_revenue
       FROM products p
       LEFT JOIN (SELECT product_id, count(DISTINCT invoice_id) AS n, sum(quantity) AS q, sum(total_price) AS r FROM invoice_items GROUP BY ALL) s ON s.product_id = p.id
       LEFT JOIN (SELECT product_id, count(DISTINCT delivery_id) AS n FROM delivery_items GROUP BY ALL) v ON v.product_id = p.id""",
)
register(
    "product_stats_fanout", lambda d: stats.product_stats_fanout(d),
    """SELECT p.id, p.code, p.name, count(DISTINCT l.invoice_id) AS invoice_count, count(DISTINCT e.delivery_id) AS delivery_count,
              cast(coalesce(sum(l.quantity), 0) AS bigint) AS total_sold_quantity, cast(coalesce(sum(l.total_price), 0) AS decimal(28,2)) AS total_revenue
       FROM products p LEFT JOIN invoice_items l ON p.id = l.product_id LEFT JOIN delivery_items e ON p.id = e.product_id
       GROUP BY p.id, p.code, p.name""",
)
_START, _END = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 25, 12)
_BOUNDS = "created_at >= TIMESTAMP '2024-01-03' AND created_at <= TIMESTAMP '2024-01-25 12:00:00'"
_OVERVIEW = """SELECT count(*) AS total_actions, count(DISTINCT user_id) AS unique_users, count(DISTINCT entity_type) AS entity_types,
    count(DISTINCT cast(created_at AS date)) AS active_days FROM activity_logs"""
register("activity_overview", lambda d: stats.activity_overview(stats.stats_logs(d)), _OVERVIEW)
register("activity_overview_between", lambda d: stats.activity_overview(stats.stats_logs(d, _START, _END)), f"{_OVERVIEW} WHERE {_BOUNDS}")
register(
    "actions_by_type", lambda d: stats.actions_by_type(stats.stats_logs(d, _START, _END)),
    f"SELECT entity_type, count(*) AS count FROM activity_logs WHERE {_BOUNDS} GROUP BY entity_type ORDER BY count(*) DESC, entity_type NULLS LAST LIMIT 10",
)
register(
    "actions_by_user", lambda d: stats.actions_by_user(stats.stats_logs(d, _START, _END), d.users),
    f"""SELECT username, full_name, count FROM (
          SELECT u.id, u.username, u.full_name, count(*) AS count FROM activity_logs l LEFT JOIN users u ON l.user_id = u.id
          WHERE l.{_BOUNDS.replace('AND ', 'AND l.')} GROUP BY ALL ORDER BY count(*) DESC, u.id NULLS LAST LIMIT 10) t WHERE username IS NOT NULL""",
)
register(
    "client_dependencies", lambda d: stats.client_dependencies(d),
    """SELECT c.id, (SELECT count(*) FROM invoices i WHERE i.client_id = c.id) AS invoice_count,
              (SELECT count(*) FROM deliveries v WHERE v.client_id = c.id) AS delivery_count FROM clients c""",
)
register(
    "product_usage", lambda d: stats.product_usage(d),
    """SELECT p.id, (SELECT count(*) FROM invoice_items i WHERE i.product_id = p.id) AS invoice_usage,
              (SELECT count(*) FROM delivery_items v WHERE v.product_id = p.id) AS delivery_usage FROM products p""",
)

# --- exports

_INVOICES = """SELECT i.number AS "Invoice Number", i.date AS "Date", i.due_date AS "Due Date", c.name AS "Client Name",
    c.legal_name AS "Client Legal Name", i.subtotal AS "Subtotal", i.vat_amount AS "VAT Amount", i.total AS "Total", i.status AS "Status",
    CASE WHEN i.is_delivered THEN 'Yes' ELSE 'No' END AS "Delivered", CASE WHEN i.is_paid THEN 'Yes' ELSE 'No' END AS "Paid",
    i.notes AS "Notes", i.created_at AS "Created At" FROM invoices i JOIN clients c ON i.client_id = c.id"""
register("export_invoices", lambda d: export.export_invoices(d), _INVOICES)
register(
    "export_invoices_filtered",
    lambda d: export.export_invoices(d, "confirmed", start=dt.date(1997, 1, 1), end=dt.date(1998, 12, 31)),
    _INVOICES + " WHERE i.status = 'confirmed' AND i.date >= DATE '1997-01-01' AND i.date <= DATE '1998-12-31'",
)
register(
    "export_deliveries", lambda d: export.export_deliveries(d, start=dt.date(1997, 1, 1)),
    """SELECT i.number AS "Delivery Number", i.date AS "Date", i.due_date AS "Due Date", c.name AS "Client Name",
              c.legal_name AS "Client Legal Name", i.delivery_method AS "Delivery Method", i.status AS "Status",
              CASE WHEN i.is_signed THEN 'Yes' ELSE 'No' END AS "Signed", i.notes AS "Notes", i.created_at AS "Created At"
       FROM deliveries i JOIN clients c ON i.client_id = c.id WHERE i.date >= DATE '1997-01-01'""",
)
register(
    "export_clients", lambda d: export.export_clients(d, "1 doo"),
    f"""SELECT name AS "Name", legal_name AS "Legal Name", mb AS "MB", pib AS "PIB", address AS "Address", city AS "City",
               municipality AS "Municipality", email AS "Email",
               {nulls('varchar', '"Contact Person"', '"Phone"', '"Telegram"', '"Instagram"', '"Notes"')},
               CASE WHEN installment_payment THEN 'Yes' ELSE 'No' END AS "Installment Payment", installment_term AS "Installment Term",
               CASE WHEN showcase THEN 'Yes' ELSE 'No' END AS "Showcase", CASE WHEN bar THEN 'Yes' ELSE 'No' END AS "Bar",
               cast(NULL AS timestamp) AS "Created At"
        FROM clients WHERE name ILIKE '%1 doo%' OR legal_name ILIKE '%1 doo%' OR mb ILIKE '%1 doo%' OR pib ILIKE '%1 doo%'""",
)
register(
    "export_products", lambda d: export.export_products(d, only_active=True),
    """SELECT code AS "Code", name AS "Name", price AS "Price", weight AS "Weight (g)", category AS "Category",
              cast(NULL AS varchar) AS "Description", CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS "Status",
              cast(NULL AS timestamp) AS "Created At" FROM products WHERE is_active""",
)
register(
    "export_product_groups", lambda d: export.export_product_groups(d),
    """SELECT g.name AS "Group Name", g.quantity_type AS "Quantity Type", g.original_quantity AS "Original Quantity",
              g.current_quantity AS "Current Quantity", g.shipment_date AS "Shipment Date", g.reservation_type AS "Reservation Type",
              g.reservation_amount AS "Reservation Amount",
              1 AS "Part", coalesce(string_agg(p.name, '; ' ORDER BY p.name) FILTER (WHERE p.name <> ''), '') AS "Products", g.created_at AS "Created At"
       FROM product_groups g LEFT JOIN product_group_items b ON g.id = b.group_id LEFT JOIN products p ON b.product_id = p.id
       GROUP BY g.id, g.name, g.quantity_type, g.original_quantity, g.current_quantity, g.shipment_date, g.reservation_type, g.reservation_amount, g.created_at""",
)
_LOGS = """SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS "Date", coalesce(username, 'System') AS "User", action AS "Action",
    entity_type AS "Entity Type", entity_id AS "Entity ID", ip_address AS "IP Address", details AS "Details" FROM (
    SELECT l.*, u.username FROM activity_logs l LEFT JOIN users u ON l.user_id = u.id {where}
    ORDER BY l.created_at DESC NULLS FIRST, l.id {limit}) t"""
register("export_logs", lambda d: export.export_logs(d), _LOGS.format(where="", limit=""))
register("export_logs_newest", lambda d: export.export_logs(d, cap=500), _LOGS.format(where="", limit="LIMIT 500"))
register(
    "export_logs_search", lambda d: export.export_logs(d, start=_START, search="user_2"),
    _LOGS.format(where="WHERE l.created_at >= TIMESTAMP '2024-01-03' AND (l.action ILIKE '%user_2%' OR u.username ILIKE '%user_2%')", limit=""),
)


_AT = dt.datetime(2024, 2, 1)


def _usage(d):
    """The log rows of handing out three datasets."""
    rows = [
        export.export_log(export.export_invoices(d, "confirmed"), "invoices", _AT, 1, {"status": "confirmed", "client_id": None}),
        export.export_log(export.export_products(d, only_active=True), "products", _AT, 2, {"active_only": "true"}),
        export.view_log(d.product_groups, _AT, 3),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), rows).select("request_id", "action", "entity_type", "details")


_STAMP = '"timestamp":"2024-02-01T00:00:00.000Z"'
register(
    "usage_log", _usage,
    f"""SELECT 1 AS request_id, 'EXPORT_INVOICES' AS action, 'invoices' AS entity_type,
           '{{"format":"csv","count":' || count(*) || ',"filters":{{"status":"confirmed"}},{_STAMP}}}' AS details FROM invoices WHERE status = 'confirmed'
        UNION ALL SELECT 2, 'EXPORT_PRODUCTS', 'products', '{{"format":"csv","count":' || count(*) || ',"filters":{{"active_only":"true"}},{_STAMP}}}' FROM products WHERE is_active
        UNION ALL SELECT 3, 'VIEW_PRODUCT_GROUPS', 'product_groups', '{{"count":' || count(*) || ',{_STAMP}}}' FROM product_groups""",
)


def _csv_invoices(d):
    rows = export.export_invoices(d)
    path = scratch_path(d.spark, "invoices-csv")
    write_csv(rows, path)
    return read_csv(d.spark, path, rows.schema)


def _json_products(d):
    rows = export.export_products(d)
    path = scratch_path(d.spark, "products-json")
    write_json(rows, path)
    return d.spark.read.schema(rows.schema).json(path)


register("write_csv", _csv_invoices, _INVOICES)
register(
    "write_json", _json_products,
    """SELECT code AS "Code", name AS "Name", price AS "Price", weight AS "Weight (g)", category AS "Category",
              cast(NULL AS varchar) AS "Description", CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS "Status",
              cast(NULL AS timestamp) AS "Created At" FROM products""",
)
