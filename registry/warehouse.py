"""Registered queries: warehouse stock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.book import register
from tradebook.operators import documents, stock

NOW = dt.datetime(2024, 2, 1)
ONE_UPDATE = """'{"group_id":' || group_id || ',"product_code":' || to_json(product_code) || ',"product_name":' || to_json(product_name) ||
      ',"quantity_used":' || quantity || ',"weight_used":' || weight_used || ',"old_stock":' || old_stock || ',"new_stock":' || new_stock || '}'"""
# Every draft invoice confirmed at once.
DRAFTS_SQL = "drafts AS (SELECT id AS request_id, id AS invoice_id, date FROM invoices WHERE status = 'draft')"


def lines_sql(entered: str) -> str:
    return f"""lines AS (
      SELECT e.request_id, e.invoice_id, e.date, l.id AS item_id, l.product_id, l.quantity, b.group_id, p.code AS product_code, p.name AS product_name,
             cast(p.weight * l.quantity AS decimal(20,2)) AS weight_used
      FROM {entered} e JOIN invoice_items l ON l.invoice_id = e.invoice_id JOIN products p ON p.id = l.product_id AND p.weight > 0
      JOIN (SELECT product_id, min(group_id) AS group_id FROM product_group_items GROUP BY product_id) b ON b.product_id = l.product_id)"""


def walk_sql(order: str) -> str:
    return f"""walk AS (
      SELECT w.*, cast(greatest(0, g.current_quantity - run + weight_used) AS decimal(12,2)) AS old_stock,
             cast(greatest(0, g.current_quantity - run) AS decimal(12,2)) AS new_stock
      FROM (SELECT *, sum(weight_used) OVER (PARTITION BY group_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM lines) w
      JOIN product_groups g ON g.id = w.group_id)"""


WALK_ORDER = "request_id, item_id"
BALANCE_SQL = """SELECT g.id, g.name, cast(greatest(0, g.current_quantity - coalesce(u.used, 0)) AS decimal(12,2)) AS current_quantity
    FROM product_groups g LEFT JOIN (SELECT group_id, sum(weight_used) AS used FROM lines GROUP BY group_id) u ON u.group_id = g.id"""


def drafts(d):
    return d.invoices.filter("status = 'draft'").select(F.col("id").alias("request_id"), F.col("id").alias("invoice_id"), "date")


def stores(d):
    return d.invoice_items, d.products, d.product_group_items, d.product_groups


register(
    "initial_stock",
    lambda d: stock.opening_balances(d.product_groups).select("id", "original_quantity", "reservation_amount", "initial_quantity"),
    """SELECT id, original_quantity, reservation_amount,
              cast(greatest(0, original_quantity - original_quantity * 0.05 - reservation_amount) AS decimal(12,2)) AS initial_quantity FROM product_groups""",
)
register(
    "stock_walk",
    lambda d: stock.stock_walk(drafts(d), *stores(d)).select(
        "group_id", "invoice_id", "item_id", "date", "product_code", "product_name", "quantity", "weight_used", "old_stock", "new_stock"),
    f"""WITH {DRAFTS_SQL}, {lines_sql('drafts')}, {walk_sql(WALK_ORDER)}
        SELECT group_id, invoice_id, item_id, date, product_code, product_name, quantity, weight_used, old_stock, new_stock FROM walk""",
)
register(
    "stock_balance",
    lambda d: stock.stock_balance(drafts(d), *stores(d)).select("id", "name", "current_quantity"),
    f"WITH {DRAFTS_SQL}, {lines_sql('drafts')} {BALANCE_SQL}",
)


def _given(d):
    return d.invoice_items.select(F.col("id").alias("line_no"), "product_id", "quantity")


_GIVEN = """lines AS (SELECT l.id AS line_no, l.product_id, l.quantity, b.group_id, p.code AS product_code, cast(p.weight * l.quantity AS decimal(20,2)) AS weight_used
    FROM invoice_items l JOIN products p ON p.id = l.product_id
    JOIN (SELECT product_id, min(group_id) AS group_id FROM product_group_items GROUP BY product_id) b ON b.product_id = l.product_id)"""
register(
    "apply_stock",
    lambda d: stock.apply_stock(_given(d), *stores(d)[1:]).select("line_no", "group_id", "product_code", "quantity", "weight_used", "old_stock", "new_stock"),
    f"WITH {_GIVEN}, {walk_sql('line_no')} SELECT line_no, group_id, product_code, quantity, weight_used, old_stock, new_stock FROM walk",
)
def _given_log(d):
    lines = d.invoice_items.select(F.col("id").alias("line_no"), F.col("invoice_id").alias("request_id"), "product_id", "quantity")
    log = documents.direct_stock_log(stock.apply_stock(lines, *stores(d)[1:]), NOW)
    return log.select("request_id", "action", "entity_type", "details")


register(
    "apply_stock_log", _given_log,
    f"""WITH {_GIVEN.replace("l.id AS line_no,", "l.id AS line_no, l.invoice_id AS request_id, p.name AS product_name,")}, {walk_sql('line_no')}
        SELECT request_id, 'UPDATE_STOCK_ON_INVOICE_APPROVAL' AS action, 'product_groups' AS entity_type, '{{"updates":[' || string_agg({ONE_UPDATE}, ',' ORDER BY line_no) ||
          '],"part":1,"timestamp":"2024-02-01T00:00:00.000Z"}}' AS details FROM walk GROUP BY request_id""",
)
register(
    "apply_stock_balance",
    lambda d: stock.apply_stock_balance(_given(d), *stores(d)[1:]).select("id", "name", "current_quantity"),
    f"WITH {_GIVEN} {BALANCE_SQL}",
)


def _flat_updates(d):
    rows = stock.stock_updates(stock.stock_walk(drafts(d), *stores(d)))
    text = F.transform("updates", lambda u: F.concat_ws("|", *[u[c] for c in (
        "group_id", "product_code", "quantity_used", "weight_used", "old_stock", "new_stock")]))
    return rows.select("invoice_id", "part", F.array_join(text, ";").alias("updates"))


register(
    "stock_updates", _flat_updates,
    f"""WITH {DRAFTS_SQL}, {lines_sql('drafts')}, {walk_sql(WALK_ORDER)}
        SELECT invoice_id, 1 AS part, string_agg(concat_ws('|', group_id, product_code, quantity, weight_used, old_stock, new_stock), ';' ORDER BY item_id) AS updates
        FROM walk GROUP BY invoice_id""",
)
def updates_sql(walk: str) -> str:
    """Rows (request_id, invoice_id, details): the log of each confirmation, all its updates in one part."""
    return f"""SELECT request_id, invoice_id, count(*) AS update_count, '{{"invoice_id":' || invoice_id || ',"updates":[' ||
      string_agg({ONE_UPDATE}, ',' ORDER BY item_id) || '],"part":1,"timestamp":"2024-02-01T00:00:00.000Z"}}' AS details FROM {walk} GROUP BY request_id, invoice_id"""


register(
    "stock_update_log",
    lambda d: stock.stock_update_log(stock.stock_walk(drafts(d), *stores(d)), NOW).select(
        "invoice_id", "part", "action", "entity_type", "update_count", "details"),
    f"""WITH {DRAFTS_SQL}, {lines_sql('drafts')}, {walk_sql(WALK_ORDER)}
        SELECT invoice_id, 1 AS part, 'UPDATE_STOCK_ON_INVOICE_CONFIRMATION' AS action, 'product_groups' AS entity_type, update_count, details
        FROM ({updates_sql('walk')}) u""",
)
ASSIGN_SQL = """judged AS (
    SELECT r.*, CASE WHEN r.group_id NOT IN (SELECT id FROM product_groups) THEN 'group_not_found'
                     WHEN p.id IS NULL THEN 'product_not_found' WHEN coalesce(p.weight, 0) <= 0 THEN 'no_weight'
                     WHEN r.product_id IN (SELECT product_id FROM product_group_items) THEN 'already_grouped' END AS reason0
    FROM group_product_requests r LEFT JOIN products p ON p.id = r.product_id),
  verdict AS (
    SELECT request_id, group_id, product_id, CASE WHEN reason0 IS NOT NULL THEN reason0
           WHEN row_number() OVER (PARTITION BY product_id, reason0 IS NULL ORDER BY request_id) > 1 THEN 'already_grouped' END AS reason FROM judged)"""
register(
    "assignable",
    lambda d: stock.assignable(d.group_product_requests, d.product_groups, d.products, d.product_group_items),
    f"WITH {ASSIGN_SQL} SELECT request_id, group_id, product_id, reason FROM verdict",
)
STEPS_SQL = """steps AS (
    SELECT r.request_id, r.id, i.date, r.status, coalesce(lag(r.status) OVER (PARTITION BY r.id ORDER BY r.request_id), i.status) AS old_status
    FROM status_requests r JOIN invoices i ON i.id = r.id),
  entered AS (SELECT request_id, id AS invoice_id, date FROM steps WHERE status = 'confirmed' AND old_status <> 'confirmed')"""
register(
    "status_steps",
    lambda d: documents.status_steps(d.invoices, d.status_requests),
    f"WITH {STEPS_SQL} SELECT request_id, id, date, old_status, status FROM steps",
)
register(
    "stock_walk_requests",
    lambda d: stock.stock_walk(documents.confirmations(documents.status_steps(d.invoices, d.status_requests)), *stores(d)).select(
        "request_id", "group_id", "invoice_id", "item_id", "weight_used", "old_stock", "new_stock"),
    f"""WITH {STEPS_SQL}, {lines_sql('entered')}, {walk_sql(WALK_ORDER)}
        SELECT request_id, group_id, invoice_id, item_id, weight_used, old_stock, new_stock FROM walk""",
)
