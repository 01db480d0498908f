"""Registered queries: change sets, merges and table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.book import register
from registry.lists import nulls
from registry.rules import CLIENTS_SQL, DELIVERIES_SQL, GROUPS_SQL, INVOICES_SQL, PRODUCTS_SQL, USERS_SQL, union
from registry.warehouse import ASSIGN_SQL, BALANCE_SQL, STEPS_SQL, WALK_ORDER, lines_sql, updates_sql, walk_sql
from tradebook.operators import changes, documents, merge, registers
from tradebook.session import scratch_path
from tradebook.sources import model, snapshots

NOW = dt.datetime(2024, 2, 1)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
STAMP = '"timestamp":"2024-02-01T00:00:00.000Z"'
BIG = 10_000_000_000


def ids(table: str):
    """Ids for new rows in the id type of the views."""
    if table == "product_groups":
        return F.col("request_id") + 1000
    if table in ("invoice_items", "delivery_items"):
        return F.concat_ws(":", "request_id", "line_no")
    return F.col("request_id") + BIG


def change(name: str, run, parts: dict[str, tuple]) -> None:
    """Register one query per part of a change: part name -> (pick, oracle)."""
    for part, (pick, sql) in parts.items():
        register(name if part == "" else f"{name}_{part}", lambda d, pick=pick: pick(run(d)), sql)


def state(table: str, *columns: str):
    return lambda c: c.tables[table].select(*columns)


def refused(c):
    return c.rejected.select("request_id", "reason")


def logged(c):
    return c.activity.select("request_id", "action", "entity_type", F.col("entity_id").cast("string").alias("entity_id"), "details", "created_at")


def bad_ids(parts: list[str]) -> str:
    return f"SELECT DISTINCT cast(split_part(row_id, ':', 1) AS bigint) AS request_id FROM ({union(parts)}) v"


# --- invoices and deliveries

FAR_QUANTITY = "try_cast(quantity AS int) IS NULL"
FAR_LINE = f"""{FAR_QUANTITY} OR try_cast(unit_price AS decimal(10,2)) IS NULL
    OR try_cast(quantity AS int) * try_cast(unit_price AS double) > 9999999999.99"""


def verdict_sql(requests: str, table: str, parts: list[str], far: str) -> str:
    """Verdicts on documents; ``far`` says which lines no column can take."""
    return f"""bad AS ({bad_ids(parts)}),
      judged AS (
        SELECT r.*, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'invalid'
               WHEN request_id IN (SELECT request_id FROM invoice_request_lines WHERE {far}) THEN 'out_of_range' WHEN number IN (SELECT number FROM {table}) THEN 'duplicate_number'
               WHEN client_id NOT IN (SELECT id FROM clients) THEN 'unknown_client'
               WHEN request_id IN (SELECT request_id FROM invoice_request_lines WHERE product_id NOT IN (SELECT id FROM products)) THEN 'unknown_product' END AS reason0
        FROM {requests} r),
      verdict AS (
        SELECT *, CASE WHEN reason0 IS NOT NULL THEN reason0
               WHEN row_number() OVER (PARTITION BY number, reason0 IS NULL ORDER BY request_id) > 1 THEN 'duplicate_number' END AS reason FROM judged),
      good AS (SELECT * FROM verdict WHERE reason IS NULL)"""


_INVOICE_VERDICT = verdict_sql("invoice_requests", "invoices", INVOICES_SQL, FAR_LINE)
_NEW_INVOICES = f"""{_INVOICE_VERDICT},
  sums AS (SELECT request_id, sum(cast(try_cast(unit_price AS decimal(10,2)) * 100 AS bigint) * try_cast(quantity AS int)) AS cents, count(*) AS item_count
           FROM invoice_request_lines WHERE request_id IN (SELECT request_id FROM good) GROUP BY request_id),
  fresh AS (SELECT g.*, s.item_count, cast(cast(s.cents AS decimal(18,0)) / 100 AS decimal(12,2)) AS subtotal,
                   cast(cast((s.cents * cast(vat_rate AS bigint) + 50) // 100 AS decimal(18,0)) / 100 AS decimal(12,2)) AS vat_amount,
                   cast(cast((s.cents * (100 + cast(vat_rate AS bigint)) + 50) // 100 AS decimal(18,0)) / 100 AS decimal(12,2)) AS total
            FROM good g JOIN sums s ON s.request_id = g.request_id)"""


def _create_invoices(d):
    return documents.create_invoices(d, d.invoice_requests, d.invoice_request_lines, NOW, ids)


_HEAD = ("id", "number", "date", "due_date", "client_id", "vat_rate", "subtotal", "vat_amount", "total", "status", "is_paid", "created_at", "updated_at")
change("create_invoices", _create_invoices, {
    "": (state("invoices", *_HEAD), f"""WITH {_NEW_INVOICES}
        SELECT id, number, date, due_date, client_id, vat_rate, subtotal, vat_amount, total, status, is_paid, created_at, cast(NULL AS timestamp) AS updated_at FROM invoices
        UNION ALL
        SELECT request_id + {BIG}, number, cast(date AS date), cast(due_date AS date), client_id, cast(vat_rate AS decimal(5,2)), subtotal, vat_amount, total,
               'draft', false, {NOW_SQL}, {NOW_SQL} FROM fresh"""),
    "items": (state("invoice_items", "id", "invoice_id", "product_id", "quantity", "unit_price", "total_price", "created_at"),
              f"""WITH {_INVOICE_VERDICT}
        SELECT id, invoice_id, product_id, quantity, unit_price, total_price, created_at FROM invoice_items
        UNION ALL
        SELECT l.request_id || ':' || l.line_no, l.request_id + {BIG}, l.product_id, try_cast(l.quantity AS int), try_cast(l.unit_price AS decimal(10,2)),
               try_cast(try_cast(l.unit_price AS decimal(10,2)) * try_cast(l.quantity AS int) AS decimal(12,2)), {NOW_SQL}
        FROM invoice_request_lines l JOIN good g ON g.request_id = l.request_id"""),
    "rejected": (refused, f"WITH {_INVOICE_VERDICT} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
    "activity": (logged, f"""WITH {_NEW_INVOICES}
        SELECT request_id, 'CREATE_INVOICE' AS action, 'invoices' AS entity_type, cast(request_id + {BIG} AS varchar) AS entity_id,
               '{{"number":"' || number || '","client_id":' || client_id || ',"total":' || total || ',"item_count":' || item_count || ',{STAMP}}}' AS details,
               {NOW_SQL} AS created_at FROM fresh"""),
})

_DELIVERY_VERDICT = verdict_sql("delivery_requests", "deliveries", DELIVERIES_SQL, FAR_QUANTITY)


def _create_deliveries(d):
    return documents.create_deliveries(d, d.delivery_requests, d.invoice_request_lines, NOW, ids)


change("create_deliveries", _create_deliveries, {
    "": (state("deliveries", "id", "number", "date", "due_date", "client_id", "status", "is_signed", "created_at"), f"""WITH {_DELIVERY_VERDICT}
        SELECT id, number, date, due_date, client_id, status, is_signed, created_at FROM deliveries
        UNION ALL
        SELECT request_id + {BIG}, number, cast(date AS date), cast(due_date AS date), client_id, 'draft', false, {NOW_SQL} FROM good"""),
    "items": (state("delivery_items", "id", "delivery_id", "product_id", "quantity", "unit"), f"""WITH {_DELIVERY_VERDICT}
        SELECT id, delivery_id, product_id, quantity, unit FROM delivery_items
        UNION ALL
        SELECT l.request_id || ':' || l.line_no, l.request_id + {BIG}, l.product_id, try_cast(l.quantity AS int), coalesce(l.unit, 'ком')
        FROM invoice_request_lines l JOIN good g ON g.request_id = l.request_id"""),
    "rejected": (refused, f"WITH {_DELIVERY_VERDICT} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})

_LAST_STATUS = "last AS (SELECT id, max_by(status, request_id) AS status FROM status_requests WHERE id IN (SELECT id FROM {t}) GROUP BY id)"
_UNKNOWN = "SELECT request_id, 'not_found' AS reason FROM status_requests WHERE id NOT IN (SELECT id FROM {t})"


def _set_invoice_status(d):
    return documents.set_invoice_status(d, d.status_requests.select("request_id", "id", "status"), NOW)


change("set_invoice_status", _set_invoice_status, {
    "": (state("invoices", "id", "status", "updated_at"), f"""WITH {_LAST_STATUS.format(t='invoices')}
        SELECT i.id, coalesce(l.status, i.status) AS status, CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} END AS updated_at
        FROM invoices i LEFT JOIN last l ON l.id = i.id"""),
    "stock": (state("product_groups", "id", "name", "current_quantity"), f"WITH {STEPS_SQL}, {lines_sql('entered')} {BALANCE_SQL}"),
    "rejected": (refused, _UNKNOWN.format(t="invoices")),
    "activity": (logged, f"""WITH {STEPS_SQL}, {lines_sql('entered')}, {walk_sql(WALK_ORDER)}
        SELECT request_id, 'UPDATE_INVOICE_STATUS_' || upper(status) AS action, 'invoices' AS entity_type, cast(id AS varchar) AS entity_id,
               '{{"old_status":"' || old_status || '","new_status":"' || status || '",{STAMP}}}' AS details, {NOW_SQL} AS created_at FROM steps
        UNION ALL SELECT request_id, 'UPDATE_STOCK_ON_INVOICE_CONFIRMATION', 'product_groups', NULL, details, {NOW_SQL} FROM ({updates_sql('walk')}) u"""),
})
change("set_delivery_status", lambda d: documents.set_delivery_status(d, d.status_requests.select("request_id", "id", "status"), NOW), {
    "": (state("deliveries", "id", "status", "updated_at"), f"""WITH {_LAST_STATUS.format(t='deliveries')}
        SELECT i.id, coalesce(l.status, i.status) AS status, CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} END AS updated_at
        FROM deliveries i LEFT JOIN last l ON l.id = i.id"""),
    "rejected": (refused, _UNKNOWN.format(t="deliveries")),
})


def _tracking(d):
    return d.status_requests.select("request_id", "id", F.col("flag_a").alias("is_delivered"), F.col("flag_b").alias("is_paid"))


_PATCHED = """last AS (SELECT id, max_by(flag_a, request_id) FILTER (WHERE flag_a IS NOT NULL) AS a, max_by(flag_b, request_id) FILTER (WHERE flag_b IS NOT NULL) AS b
    FROM status_requests WHERE flag_a IS NOT NULL OR flag_b IS NOT NULL GROUP BY id)"""
change("set_invoice_tracking", lambda d: documents.set_invoice_tracking(d, _tracking(d), NOW), {
    "": (state("invoices", "id", "is_delivered", "is_paid", "updated_at"), f"""WITH {_PATCHED}
        SELECT i.id, coalesce(l.a, i.is_delivered) AS is_delivered, coalesce(l.b, i.is_paid) AS is_paid,
               CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} END AS updated_at FROM invoices i LEFT JOIN last l ON l.id = i.id"""),
    "rejected": (refused, """SELECT request_id, CASE WHEN flag_a IS NULL AND flag_b IS NULL THEN 'no_fields' ELSE 'not_found' END AS reason FROM status_requests
        WHERE (flag_a IS NULL AND flag_b IS NULL) OR id NOT IN (SELECT id FROM invoices)"""),
})
change("set_delivery_signed",
       lambda d: documents.set_delivery_signed(d, d.status_requests.select("request_id", "id", F.col("flag_a").alias("is_signed")), NOW), {
    "": (state("deliveries", "id", "is_signed", "updated_at"), f"""WITH last AS (SELECT id, max_by(flag_a, request_id) AS a FROM status_requests WHERE flag_a IS NOT NULL GROUP BY id)
        SELECT i.id, coalesce(l.a, i.is_signed) AS is_signed, CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} END AS updated_at
        FROM deliveries i LEFT JOIN last l ON l.id = i.id"""),
    "rejected": (refused, """SELECT request_id, CASE WHEN flag_a IS NULL THEN 'no_fields' ELSE 'not_found' END AS reason FROM status_requests
        WHERE flag_a IS NULL OR id NOT IN (SELECT id FROM deliveries)"""),
})
for _table, _run, _items, _key in (
    ("invoices", documents.delete_invoices, "invoice_items", "invoice_id"),
    ("deliveries", documents.delete_deliveries, "delivery_items", "delivery_id"),
):
    _gone = f"SELECT t.id FROM {_table} t WHERE t.status <> 'confirmed' AND t.id IN (SELECT id FROM status_requests)"
    change(f"delete_{_table}", lambda d, run=_run: run(d, d.status_requests.select("request_id", "id"), NOW), {
        "": (state(_table, "id", "number", "status"), f"SELECT id, number, status FROM {_table} WHERE id NOT IN ({_gone})"),
        "items": (state(_items, "id", _key, "product_id"), f"SELECT id, {_key}, product_id FROM {_items} WHERE {_key} NOT IN ({_gone})"),
        "rejected": (refused, f"""SELECT request_id, reason FROM (
            SELECT r.request_id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN t.status = 'confirmed' THEN 'confirmed'
                   WHEN row_number() OVER (PARTITION BY r.id ORDER BY r.request_id) > 1 THEN 'not_found' END AS reason
            FROM status_requests r LEFT JOIN {_table} t ON t.id = r.id) v WHERE reason IS NOT NULL"""),
    })

# --- clients

_EMAIL = "lower(trim(email))"
FAR_CLIENT = "installment_term IS NOT NULL AND try_cast(installment_term AS int) IS NULL"


def two_keys_sql(requests: str, bad: str, a: str, b: str, base: str, far: str = "false") -> str:
    """Taking requests one by one on two keys, unrolled to the two rounds this data needs.

    Round one passes leaders on both keys; those they beat leave; round two passes the leaders among
    the rest.
    """
    return f"""bad AS ({bad}),
      judged AS (SELECT r.*, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'invalid' WHEN {far} THEN 'out_of_range'
                   WHEN {a} IN (SELECT {a} FROM {base}) OR coalesce({b} IN (SELECT {b} FROM {base} WHERE {b} IS NOT NULL), false) THEN 'duplicate' END AS reason0 FROM {requests} r),
      open1 AS (SELECT *, row_number() OVER (PARTITION BY {a} ORDER BY request_id) AS ra,
                  CASE WHEN {b} IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY {b} ORDER BY request_id) END AS rb FROM judged WHERE reason0 IS NULL),
      won1 AS (SELECT * FROM open1 WHERE ra = 1 AND rb = 1),
      open2 AS (SELECT request_id, {a}, {b}, row_number() OVER (PARTITION BY {a} ORDER BY request_id) AS ra,
                  CASE WHEN {b} IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY {b} ORDER BY request_id) END AS rb FROM open1
                WHERE {a} NOT IN (SELECT {a} FROM won1) AND coalesce({b} NOT IN (SELECT {b} FROM won1 WHERE {b} IS NOT NULL), true)),
      won AS (SELECT request_id FROM won1 UNION ALL SELECT request_id FROM open2 WHERE ra = 1 AND rb = 1),
      verdict AS (SELECT j.*, CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN request_id NOT IN (SELECT request_id FROM won) THEN 'duplicate' END AS reason FROM judged j),
      good AS (SELECT * FROM verdict WHERE reason IS NULL)"""


_CLIENT_VERDICT = two_keys_sql("client_requests", bad_ids(CLIENTS_SQL), "mb", "pib", "clients", FAR_CLIENT)
change("create_clients", lambda d: registers.create_clients(d, d.client_requests, NOW, ids), {
    "": (state("clients", "id", "name", "mb", "pib", "email", "installment_payment", "installment_term", "showcase", "created_at"), f"""WITH {_CLIENT_VERDICT}
        SELECT id, name, mb, pib, email, installment_payment, installment_term, showcase, cast(NULL AS timestamp) AS created_at FROM clients
        UNION ALL
        SELECT request_id + {BIG}, trim(name), mb, pib, {_EMAIL}, false, try_cast(installment_term AS int), false, {NOW_SQL} FROM good"""),
    "rejected": (refused, f"WITH {_CLIENT_VERDICT} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
    "activity": (logged, f"""WITH {_CLIENT_VERDICT} SELECT request_id, 'Created client: ' || trim(name) AS action, 'client' AS entity_type,
        cast(request_id + {BIG} AS varchar) AS entity_id, '{{{STAMP}}}' AS details, {NOW_SQL} AS created_at FROM good"""),
})


def in_turn_sql(judged: str, keys: list[str], base: str, reason: str, sparse: bool = False) -> str:
    """Updates taken one by one: each step of the recursion takes the next request and carries the present keys of
    all rows changed so far. ``judged`` gives the requests with ``reason0``; the result is ``verdict``."""
    own = ", ".join(f"j.{k}" for k in keys)
    held = " UNION ALL ".join(f"SELECT j.request_id, b.id AS holder FROM judged j JOIN {base} b ON b.{k} = j.{k} AND b.id <> j.id" for k in keys)
    same = " OR ".join(f"coalesce(x.k[{i}] = k[{i}], false)" for i in range(1, len(keys) + 1))
    given = f"[coalesce(k[1], list_filter(now, lambda x: x.id = own)[1].k[1], (SELECT b.{keys[0]} FROM {base} b WHERE b.id = own))]" if sparse else "k"
    return f"""judged AS ({judged}),
  held AS (SELECT request_id, list(DISTINCT holder) AS holders FROM ({held}) GROUP BY request_id),
  asked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY j.request_id) AS n, j.request_id, j.id AS own, j.id IN (SELECT id FROM {base}) AS there,
      [{own}] AS k, coalesce(h.holders, []) AS holders FROM judged j LEFT JOIN held h ON h.request_id = j.request_id WHERE reason0 IS NULL),
  walk AS (SELECT cast(0 AS bigint) AS n, cast([] AS STRUCT(id BIGINT, k VARCHAR[])[]) AS now, cast(NULL AS bigint) AS met
    UNION ALL
    SELECT n, CASE WHEN bad OR NOT there THEN now ELSE list_append(list_filter(now, lambda x: x.id <> own), {{'id': own, 'k': {given}}}) END, CASE WHEN bad THEN request_id END
    FROM (SELECT a.*, w.now, len(list_filter(w.now, lambda x: x.id <> own AND ({same}))) > 0
            OR len(list_filter(holders, lambda h: NOT list_contains(moved, h))) > 0 AS bad
          FROM (SELECT *, list_transform(now, lambda x: x.id) AS moved FROM walk) w JOIN asked a ON a.n = w.n + 1)),
  verdict AS (SELECT j.*, CASE WHEN reason0 IS NOT NULL THEN reason0 WHEN request_id IN (SELECT met FROM walk WHERE met IS NOT NULL) THEN '{reason}'
      WHEN id NOT IN (SELECT id FROM {base}) THEN 'not_found' END AS reason FROM judged j)"""


def _aimed(target: str, key: str, form: str) -> dict[str, str]:
    """Every fifth request of ten aims at the row after its own; the third wants a key that the row before may have
    given up by then, the seventh one that the row after still has."""
    return {
        "id": f"CASE WHEN request_id % {target} = 0 THEN -1 WHEN request_id % 10 = 5 THEN request_id + 1 ELSE request_id END",
        key: f"CASE request_id % 10 WHEN 3 THEN {form.format('request_id - 1')} WHEN 7 THEN {form.format('request_id + 1')} ELSE {key} END",
    }


def _shifted(df, columns: dict[str, str]):
    return df.withColumns({c: F.expr(text) for c, text in columns.items()})


def _shifted_sql(table: str, columns: dict[str, str]) -> str:
    held = ", ".join(f"{text} AS {c}" for c, text in columns.items() if c != "id")
    return f"SELECT * REPLACE ({held}), {columns['id']} AS id FROM {table}"


_CLIENT_AIMS = _aimed("47", "mb", "lpad(cast({} AS string), 8, '0')")
_UPDATE_VERDICT = "RECURSIVE updates AS (" + _shifted_sql("client_requests", _CLIENT_AIMS) + f"""), bad AS ({bad_ids(CLIENTS_SQL)}),
  """ + in_turn_sql(f"""SELECT u.*, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'invalid' WHEN {FAR_CLIENT} THEN 'out_of_range' END AS reason0
      FROM updates u""", ["mb", "pib"], "clients", "duplicate") + """,
  last AS (SELECT * FROM verdict WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1)"""
change("update_clients", lambda d: registers.update_clients(d, _shifted(d.client_requests, _CLIENT_AIMS), NOW), {
    "": (state("clients", "id", "name", "mb", "pib", "city", "email", "installment_payment", "installment_term", "updated_at"), f"""WITH {_UPDATE_VERDICT}
        SELECT c.id, CASE WHEN g.id IS NULL THEN c.name ELSE trim(g.name) END AS name, coalesce(g.mb, c.mb) AS mb, coalesce(g.pib, c.pib) AS pib,
               CASE WHEN g.id IS NULL THEN c.city END AS city, CASE WHEN g.id IS NULL THEN c.email ELSE lower(g.email) END AS email,
               CASE WHEN g.id IS NULL THEN c.installment_payment ELSE false END AS installment_payment,
               CASE WHEN g.id IS NULL THEN c.installment_term ELSE try_cast(g.installment_term AS int) END AS installment_term,
               CASE WHEN g.id IS NOT NULL THEN {NOW_SQL} END AS updated_at
        FROM clients c LEFT JOIN last g ON g.id = c.id"""),
    "activity": (lambda c: c.activity.select("request_id", "action"), f"""WITH {_UPDATE_VERDICT}
        SELECT request_id, 'Updated client: ' || trim(name) AS action FROM verdict WHERE reason IS NULL"""),
    "rejected": (refused, f"WITH {_UPDATE_VERDICT} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})


def _with_prospects(d):
    """Clients plus one prospect without documents per supplier; every one is asked to go."""
    prospects = d.supplier.select((F.col("s_suppkey") + BIG).alias("id"), F.col("s_name").alias("name"))
    clients = d.clients.select("id", "name").unionByName(prospects)
    requests = clients.select(F.col("id").alias("request_id"), F.when(F.col("id") % 13 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"))
    tables = {"clients": clients, "invoices": d.invoices, "deliveries": d.deliveries}
    return registers.delete_clients(tables, requests, NOW)


_PROSPECTS = f"""everyone AS (SELECT id, name FROM clients UNION ALL SELECT s_suppkey + {BIG}, s_name FROM supplier),
  asked AS (SELECT id AS request_id, CASE WHEN id % 13 = 0 THEN -1 ELSE id END AS id FROM everyone),
  counts AS (SELECT e.id, (SELECT count(*) FROM invoices i WHERE i.client_id = e.id) AS invoice_count, (SELECT count(*) FROM deliveries v WHERE v.client_id = e.id) AS delivery_count FROM everyone e)"""
change("delete_clients", _with_prospects, {
    "": (state("clients", "id", "name"), f"""WITH {_PROSPECTS} SELECT e.id, e.name FROM everyone e JOIN counts c ON c.id = e.id
        WHERE NOT (e.id IN (SELECT id FROM asked) AND c.invoice_count = 0 AND c.delivery_count = 0)"""),
    "rejected": (lambda c: c.rejected, f"""WITH {_PROSPECTS} SELECT a.request_id, CASE WHEN c.id IS NULL THEN 'not_found' ELSE 'in_use' END AS reason, c.invoice_count, c.delivery_count
        FROM asked a LEFT JOIN counts c ON c.id = a.id WHERE c.id IS NULL OR c.invoice_count > 0 OR c.delivery_count > 0"""),
})

# --- products

FAR_PRODUCT = "try_cast(price AS decimal(10,2)) IS NULL OR weight IS NOT NULL AND try_cast(weight AS decimal(8,2)) IS NULL"
_PRODUCT_VERDICT = f"""bad AS ({bad_ids(PRODUCTS_SQL)}),
  judged AS (SELECT r.*, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'invalid' WHEN {FAR_PRODUCT} THEN 'out_of_range' WHEN code IN (SELECT code FROM products) THEN 'duplicate_code' END AS reason0 FROM product_requests r),
  verdict AS (SELECT *, CASE WHEN reason0 IS NOT NULL THEN reason0
      WHEN row_number() OVER (PARTITION BY code, reason0 IS NULL ORDER BY request_id) > 1 THEN 'duplicate_code' END AS reason FROM judged),
  good AS (SELECT * FROM verdict WHERE reason IS NULL)"""
_ALL_PRODUCTS = f"""everything AS (SELECT id, code, name, price, weight, category, is_active, cast(NULL AS timestamp) AS updated_at FROM products
    UNION ALL SELECT request_id + {BIG}, code, name, try_cast(price AS decimal(10,2)), cast(coalesce(try_cast(weight AS decimal(8,2)), 0) AS decimal(8,2)), NULL, true, {NOW_SQL} FROM good)"""


def _create_products(d):
    return registers.create_products(d, d.product_requests, NOW, ids)


_PRODUCT = ("id", "code", "name", "price", "weight", "category", "is_active", "updated_at")
change("create_products", _create_products, {
    "": (state("products", *_PRODUCT), f"WITH {_PRODUCT_VERDICT}, {_ALL_PRODUCTS} SELECT * FROM everything"),
    "rejected": (refused, f"WITH {_PRODUCT_VERDICT} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})


def derived_sql(*parts: str) -> str:
    """The default id of a new row: a digest of what names it, in the form of a UUID."""
    return f"regexp_replace(md5(concat_ws(chr(1), {', '.join(parts)})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _default_ids(d):
    """New products and their log with the ids the library makes, over tables with text ids."""
    tables = {"products": d.products.withColumn("id", F.col("id").cast("string"))}
    made = registers.create_products(tables, d.product_requests, NOW)
    log = changes.append_activity(d.activity_logs.limit(0).withColumn("id", F.lit("")), made.activity)
    return made.rows["products"].select("id", F.col("code").alias("text")).unionByName(log.select("id", F.col("action").alias("text")))


_PRODUCT_ID = derived_sql("'products'", "cast(request_id AS varchar)")
_LOG_ID = derived_sql("'activity_logs'", "''", "action", "'product'", "new_id", "cast(request_id AS varchar)", "'2024-02-01 00:00:00'", f"'{{{STAMP}}}'")
register(
    "default_ids", _default_ids,
    f"""WITH {_PRODUCT_VERDICT}, made AS (SELECT request_id, code, {_PRODUCT_ID} AS new_id, 'Created product: ' || name || ' (' || code || ')' AS action FROM good)
        SELECT new_id AS id, code AS text FROM made UNION ALL SELECT {_LOG_ID}, action FROM made""",
)


_PRODUCT_AIMS = _aimed("41", "code", "concat('P', lpad(cast({} AS string), 8, '0'))")
_PRODUCT_UPDATES = "RECURSIVE updates AS (" + _shifted_sql("product_requests", _PRODUCT_AIMS) + f"""), bad AS ({bad_ids(PRODUCTS_SQL)}),
  """ + in_turn_sql(f"""SELECT u.*, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'invalid' WHEN {FAR_PRODUCT} THEN 'out_of_range' END AS reason0
      FROM updates u""", ["code"], "products", "duplicate_code") + """,
  weights AS (SELECT id, max_by(weight, request_id) FILTER (WHERE weight IS NOT NULL) AS w FROM verdict WHERE reason IS NULL GROUP BY id),
  last AS (SELECT v.*, w FROM verdict v JOIN weights USING (id) WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY request_id DESC) = 1)"""
change("update_products", lambda d: registers.update_products(d, _shifted(d.product_requests, _PRODUCT_AIMS), NOW), {
    "": (state("products", *_PRODUCT), f"""WITH {_PRODUCT_UPDATES}
        SELECT p.id, coalesce(g.code, p.code) AS code, coalesce(g.name, p.name) AS name, coalesce(try_cast(g.price AS decimal(10,2)), p.price) AS price,
               coalesce(try_cast(g.w AS decimal(8,2)), p.weight) AS weight, CASE WHEN g.id IS NULL THEN p.category END AS category,
               CASE WHEN g.id IS NULL THEN p.is_active ELSE true END AS is_active, CASE WHEN g.id IS NOT NULL THEN {NOW_SQL} END AS updated_at
        FROM products p LEFT JOIN last g ON g.id = p.id"""),
    "rejected": (refused, f"WITH {_PRODUCT_UPDATES} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})


def _retire(d):
    """Every product, the newly created ones among them, is asked to retire."""
    products = _create_products(d).tables["products"]
    tables = {n: d[n] for n in ("invoice_items", "delivery_items", "product_group_items")} | {"products": products}
    asked = products.select(F.col("id").alias("request_id"), F.when(F.col("id") % 17 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"))
    return registers.retire_products(tables, asked, NOW)


_RETIRE = f"""{_PRODUCT_VERDICT}, {_ALL_PRODUCTS}, asked AS (SELECT id AS request_id, CASE WHEN id % 17 = 0 THEN -1 ELSE id END AS id FROM everything),
  used AS (SELECT product_id AS id FROM invoice_items UNION SELECT product_id FROM delivery_items)"""
change("retire_products", _retire, {
    "": (state("products", "id", "code", "is_active", "updated_at"), f"""WITH {_RETIRE}
        SELECT e.id, e.code, CASE WHEN a.id IS NULL THEN e.is_active ELSE false END AS is_active, CASE WHEN a.id IS NULL THEN e.updated_at ELSE {NOW_SQL} END AS updated_at
        FROM everything e LEFT JOIN asked a ON a.id = e.id WHERE a.id IS NULL OR e.id IN (SELECT id FROM used)"""),
    "rejected": (refused, f"WITH {_RETIRE} SELECT request_id, 'not_found' AS reason FROM asked WHERE id NOT IN (SELECT id FROM everything)"),
    "activity": (lambda c: c.activity.select("request_id", "action"), f"""WITH {_RETIRE} SELECT a.request_id,
        CASE WHEN e.id IN (SELECT id FROM used) THEN 'Deactivated' ELSE 'Deleted' END || ' product: ' || e.name || ' (' || e.code || ')' AS action
        FROM asked a JOIN everything e ON e.id = a.id"""),
})
change("activate_products", lambda d: registers.activate_products(d, d.group_product_requests.select("request_id", F.col("product_id").alias("id")), NOW), {
    "": (state("products", "id", "is_active", "updated_at"), f"""SELECT p.id, p.is_active OR r.id IS NOT NULL AS is_active, CASE WHEN r.id IS NOT NULL THEN {NOW_SQL} END AS updated_at
        FROM products p LEFT JOIN (SELECT DISTINCT product_id AS id FROM group_product_requests) r ON r.id = p.id"""),
    "rejected": (refused, "SELECT request_id, 'not_found' AS reason FROM group_product_requests WHERE product_id NOT IN (SELECT id FROM products)"),
})

# --- groups

FAR_GROUP = "try_cast(original_quantity AS decimal(12,2)) IS NULL"
change("create_groups", lambda d: registers.create_groups(d, d.group_requests, NOW, ids), {
    "": (state("product_groups", "id", "name", "quantity_type", "original_quantity", "current_quantity", "shipment_date", "reservation_amount"), f"""WITH bad AS ({bad_ids(GROUPS_SQL)})
        SELECT id, name, quantity_type, original_quantity, current_quantity, shipment_date, reservation_amount FROM product_groups
        UNION ALL
        SELECT cast(request_id + 1000 AS int), trim(name), quantity_type, try_cast(original_quantity AS decimal(12,2)),
               cast(greatest(0, try_cast(original_quantity AS decimal(12,2)) * 0.95 - coalesce(cast(reservation_amount AS decimal(12,2)), 0)) AS decimal(12,2)),
               cast(shipment_date AS date), coalesce(cast(reservation_amount AS decimal(12,2)), 0)
        FROM group_requests WHERE request_id NOT IN (SELECT request_id FROM bad) AND NOT ({FAR_GROUP})"""),
    "rejected": (refused, f"""WITH bad AS ({bad_ids(GROUPS_SQL)}) SELECT request_id, 'invalid' AS reason FROM bad
        UNION ALL SELECT request_id, 'out_of_range' FROM group_requests WHERE request_id NOT IN (SELECT request_id FROM bad) AND {FAR_GROUP}"""),
})


def _group_patches(d):
    return d.group_requests.select(
        "request_id", (F.col("request_id") % 29).cast("int").alias("id"),
        F.when(F.col("request_id") % 3 == 0, F.col("original_quantity")).alias("original_quantity"),
        F.when(F.col("request_id") % 5 == 0, F.col("name")).alias("name"))


_GROUP_PATCHES = """patches AS (SELECT request_id, cast(request_id % 29 AS int) AS id, CASE WHEN request_id % 3 = 0 THEN original_quantity END AS original_quantity,
      CASE WHEN request_id % 5 = 0 THEN trim(name) END AS name FROM group_requests),
  verdict AS (SELECT *, CASE WHEN coalesce(try_cast(original_quantity AS double) < 0.01, false) OR coalesce(name = '', false) THEN 'invalid' WHEN original_quantity IS NOT NULL AND try_cast(original_quantity AS decimal(12,2)) IS NULL THEN 'out_of_range'
      WHEN original_quantity IS NULL AND name IS NULL THEN 'no_fields' WHEN id NOT IN (SELECT id FROM product_groups) THEN 'not_found' END AS reason FROM patches),
  last AS (SELECT id, max_by(original_quantity, request_id) FILTER (WHERE original_quantity IS NOT NULL) AS q, max_by(name, request_id) FILTER (WHERE name IS NOT NULL) AS n
      FROM verdict WHERE reason IS NULL GROUP BY id)"""
change("patch_groups", lambda d: registers.patch_groups(d, _group_patches(d), NOW), {
    "": (state("product_groups", "id", "name", "original_quantity", "current_quantity", "updated_at"), f"""WITH {_GROUP_PATCHES}
        SELECT g.id, coalesce(l.n, g.name) AS name, coalesce(try_cast(l.q AS decimal(12,2)), g.original_quantity) AS original_quantity, g.current_quantity,
               CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} END AS updated_at FROM product_groups g LEFT JOIN last l ON l.id = g.id"""),
    "rejected": (refused, f"WITH {_GROUP_PATCHES} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})
change("add_group_products", lambda d: registers.add_group_products(d, d.group_product_requests, NOW, ids), {
    "": (state("product_group_items", "id", "group_id", "product_id"), f"""WITH {ASSIGN_SQL}
        SELECT id, group_id, product_id FROM product_group_items UNION ALL SELECT request_id + {BIG}, group_id, product_id FROM verdict WHERE reason IS NULL"""),
    "rejected": (refused, f"WITH {ASSIGN_SQL} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})
change("remove_group_products", lambda d: registers.remove_group_products(d, d.group_product_requests, NOW), {
    "": (state("product_group_items", "id", "group_id", "product_id"), """SELECT b.id, b.group_id, b.product_id FROM product_group_items b
        WHERE NOT EXISTS (SELECT 1 FROM group_product_requests r WHERE r.group_id = b.group_id AND r.product_id = b.product_id)"""),
    "rejected": (refused, """SELECT request_id, 'not_in_group' AS reason FROM (
        SELECT r.*, row_number() OVER (PARTITION BY group_id, product_id ORDER BY request_id) AS n FROM group_product_requests r) r
        WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM product_group_items b WHERE r.group_id = b.group_id AND r.product_id = b.product_id)"""),
})


def _empty_brands(d):
    """Ask for the groups named in the requests to go, as far as their number is odd."""
    return d.group_product_requests.select("request_id", F.when(F.col("group_id") % 2 == 1, F.col("group_id")).otherwise(F.lit(-1)).alias("id"))


_BRANDS = "asked AS (SELECT request_id, CASE WHEN group_id % 2 = 1 THEN group_id ELSE -1 END AS id FROM group_product_requests)"
change("delete_groups", lambda d: registers.delete_groups(d, _empty_brands(d), NOW), {
    "": (state("product_groups", "id", "name"), f"WITH {_BRANDS} SELECT id, name FROM product_groups WHERE id NOT IN (SELECT id FROM asked)"),
    "items": (state("product_group_items", "id", "group_id", "product_id"), f"WITH {_BRANDS} SELECT id, group_id, product_id FROM product_group_items WHERE group_id NOT IN (SELECT id FROM asked)"),
    "rejected": (refused, f"""WITH {_BRANDS} SELECT request_id, 'not_found' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY request_id) AS n FROM asked) a
        WHERE n > 1 OR id NOT IN (SELECT id FROM product_groups)"""),
})

# --- users

_USER_VERDICT = two_keys_sql("user_requests", bad_ids(USERS_SQL), "username", "email", "users")
change("create_users", lambda d: registers.create_users(d, d.user_requests, NOW, ids), {
    "": (state("users", "id", "username", "email", "full_name", "role", "is_active", "permissions"), f"""WITH {_USER_VERDICT}
        SELECT id, username, email, full_name, role, is_active, permissions FROM users
        UNION ALL SELECT request_id + {BIG}, username, email, full_name, 'user', true, '{{}}' FROM good"""),
    "rejected": (refused, f"WITH {_USER_VERDICT} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})


# The third request of ten wants the address given to the user before, the fourth one that its user gave up by then.
_ADDRESS = """CASE WHEN request_id % 10 = 3 THEN concat('u', cast(request_id + 99 AS string), '@example.com')
    WHEN request_id % 10 = 4 AND request_id > 200 THEN concat('u', cast(request_id - 63 AS string), '@example.com') ELSE email END"""


def _user_patches(d):
    return d.user_requests.select(
        "request_id", (F.col("request_id") % 160).alias("id"), F.expr(_ADDRESS).alias("email"),
        F.when(F.col("request_id") % 2 == 0, F.col("full_name")).alias("full_name"),
        F.when(F.col("request_id") % 9 == 0, F.lit('{"clients":true}')).alias("permissions"))


_USER_PATCHES = f"""RECURSIVE patches AS (SELECT request_id, request_id % 160 AS id, {_ADDRESS} AS email, CASE WHEN request_id % 2 = 0 THEN full_name END AS full_name,
      CASE WHEN request_id % 9 = 0 THEN '{{"clients":true}}' END AS permissions FROM user_requests),
  """ + in_turn_sql("""SELECT p.*, CASE WHEN email IS NULL AND full_name IS NULL AND permissions IS NULL THEN 'no_fields'
      WHEN id NOT IN (SELECT id FROM users) THEN 'not_found' END AS reason0 FROM patches p""", ["email"], "users", "duplicate", sparse=True) + """,
  last AS (SELECT id, max_by(email, request_id) FILTER (WHERE email IS NOT NULL) AS e, max_by(full_name, request_id) FILTER (WHERE full_name IS NOT NULL) AS f,
      max_by(permissions, request_id) FILTER (WHERE permissions IS NOT NULL) AS p FROM verdict WHERE reason IS NULL GROUP BY id)"""
change("patch_users", lambda d: registers.patch_users(d, _user_patches(d), NOW), {
    "": (state("users", "id", "username", "email", "full_name", "permissions", "updated_at"), f"""WITH {_USER_PATCHES}
        SELECT u.id, u.username, coalesce(l.e, u.email) AS email, coalesce(l.f, u.full_name) AS full_name, coalesce(l.p, u.permissions) AS permissions,
               CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} END AS updated_at FROM users u LEFT JOIN last l ON l.id = u.id"""),
    "rejected": (refused, f"WITH {_USER_PATCHES} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
    "activity": (logged, f"""WITH {_USER_PATCHES}
        SELECT request_id, 'Profile updated' AS action, 'user' AS entity_type, cast(id AS varchar) AS entity_id, '{{{STAMP}}}' AS details, {NOW_SQL} AS created_at
        FROM verdict WHERE reason IS NULL AND (email IS NOT NULL OR full_name IS NOT NULL)
        UNION ALL SELECT v.request_id, 'User permissions updated', 'user', cast(v.id AS varchar),
               '{{"target_username":"' || u.username || '","new_permissions":' || v.permissions || ',{STAMP}}}', {NOW_SQL}
        FROM verdict v JOIN users u ON u.id = v.id WHERE v.reason IS NULL AND v.permissions IS NOT NULL"""),
})


def _toggles(d):
    return d.user_requests.select("request_id", (F.col("request_id") % 160).alias("id"), F.lit(50).cast("long").alias("actor_id"))


_TOGGLES = "asked AS (SELECT request_id, request_id % 160 AS id FROM user_requests)"
change("toggle_users", lambda d: registers.toggle_users(d, _toggles(d), NOW), {
    "": (state("users", "id", "is_active", "updated_at"), f"""WITH {_TOGGLES}, flips AS (SELECT id, count(*) AS n FROM asked WHERE id <> 50 GROUP BY id)
        SELECT u.id, CASE WHEN coalesce(f.n, 0) % 2 = 1 THEN NOT u.is_active ELSE u.is_active END AS is_active,
               CASE WHEN f.id IS NOT NULL THEN {NOW_SQL} END AS updated_at FROM users u LEFT JOIN flips f ON f.id = u.id"""),
    "rejected": (refused, f"""WITH {_TOGGLES} SELECT request_id, CASE WHEN id = 50 THEN 'own_account' ELSE 'not_found' END AS reason FROM asked
        WHERE id = 50 OR id NOT IN (SELECT id FROM users)"""),
    "activity": (lambda c: c.activity.select("request_id", "user_id", "action"), f"""WITH {_TOGGLES}
        SELECT a.request_id, cast(50 AS bigint) AS user_id, CASE WHEN u.is_active <> (a.n % 2 = 1) THEN 'User activated' ELSE 'User deactivated' END AS action
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY request_id) AS n FROM asked) a JOIN users u ON u.id = a.id WHERE a.id <> 50"""),
})
_DELETED = f"""{_TOGGLES}, verdict AS (SELECT request_id, id, CASE WHEN id = 50 THEN 'own_account' WHEN id NOT IN (SELECT id FROM everyone) THEN 'not_found'
    WHEN id IN (SELECT user_id FROM activity_logs WHERE user_id IS NOT NULL) THEN 'in_use'
    WHEN row_number() OVER (PARTITION BY id ORDER BY request_id) > 1 THEN 'not_found' END AS reason FROM asked)"""
_EVERYONE = "everyone AS (SELECT id, username FROM users UNION ALL SELECT c_custkey, 'quiet_' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT id FROM users))"


def _delete_users(d):
    """Users plus the customers that never logged anything, who can go."""
    quiet = d.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("quiet_"), F.col("c_custkey")).alias("username"))
    quiet = quiet.join(d.users.select("id"), "id", "left_anti")
    tables = {"users": d.users.select("id", "username").unionByName(quiet), "activity_logs": d.activity_logs}
    return registers.delete_users(tables, _toggles(d), NOW)


change("delete_users", _delete_users, {
    "": (state("users", "id", "username"), f"WITH {_EVERYONE}, {_DELETED} SELECT id, username FROM everyone WHERE id NOT IN (SELECT id FROM verdict WHERE reason IS NULL)"),
    "rejected": (refused, f"WITH {_EVERYONE}, {_DELETED} SELECT request_id, reason FROM verdict WHERE reason IS NOT NULL"),
})

# --- log, triggers, merges, maintenance

register(
    "touch",
    lambda d: changes.touch(d.invoices, F.col("status") == "draft", NOW).select("id", "updated_at"),
    f"SELECT id, CASE WHEN status = 'draft' THEN {NOW_SQL} END AS updated_at FROM invoices",
)
register(
    "append_activity",
    lambda d: changes.append_activity(d.activity_logs, _create_invoices(d).activity, ids).select(
        "id", "user_id", "action", "entity_type", "entity_id", "created_at"),
    f"""WITH {_INVOICE_VERDICT} SELECT id, user_id, action, entity_type, entity_id, created_at FROM activity_logs
        UNION ALL SELECT request_id + {BIG}, NULL, 'CREATE_INVOICE', 'invoices', request_id + {BIG}, {NOW_SQL} FROM good""",
)
_CLEANED = "created_at < TIMESTAMP '2024-01-17 00:00:00'"
register(
    "cleanup_logs",
    lambda d: registers.cleanup_logs(d.activity_logs, NOW, 15, ids).tables["activity_logs"].select("id", "user_id", "action", "details", "created_at"),
    f"""SELECT id, user_id, action, details, created_at FROM activity_logs WHERE NOT ({_CLEANED})
        UNION ALL SELECT {BIG}, NULL, 'CLEANUP_OLD_LOGS',
          '{{"daysToKeep":15,"deletedCount":' || (SELECT count(*) FROM activity_logs WHERE {_CLEANED}) || ',"cutoffDate":"2024-01-17T00:00:00.000Z",{STAMP},"system":true}}', {NOW_SQL}""",
)


def _typed_updates(d):
    return d.product_requests.select(
        (F.col("request_id") + BIG).alias("id"), "request_id", "code", "name",
        F.col("price").try_cast("decimal(10,2)").alias("price"), F.col("weight").try_cast("decimal(8,2)").alias("weight"))


_TYPED_UPDATES = f"""updates AS (SELECT request_id + {BIG} AS id, request_id, code, name, try_cast(price AS decimal(10,2)) AS price, try_cast(weight AS decimal(8,2)) AS weight FROM product_requests)"""
register(
    "upsert",
    lambda d: merge.upsert(d.products.select("id", "code", "name", "price", "weight"), _typed_updates(d), ["code"], ["name", "price"], order="request_id"),
    f"""WITH {_TYPED_UPDATES}, last AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY code ORDER BY request_id DESC) = 1)
        SELECT coalesce(p.id, u.id) AS id, coalesce(p.code, u.code) AS code, CASE WHEN u.id IS NULL THEN p.name ELSE u.name END AS name,
               CASE WHEN u.id IS NULL THEN p.price ELSE u.price END AS price, CASE WHEN p.id IS NULL THEN u.weight ELSE p.weight END AS weight
        FROM products p FULL JOIN last u ON p.code = u.code""",
)
register(
    "insert_ignore",
    lambda d: merge.insert_ignore(d.products.select("id", "code", "name", "price", "weight"), _typed_updates(d), ["code"], "request_id"),
    f"""WITH {_TYPED_UPDATES}, first AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY code ORDER BY request_id) = 1)
        SELECT id, code, name, price, weight FROM products
        UNION ALL SELECT id, code, name, price, weight FROM first WHERE code NOT IN (SELECT code FROM products)""",
)
register(
    "first_come_codes",
    lambda d: merge.first_come(d.product_requests, ["code"]),
    "SELECT min(request_id) AS request_id FROM product_requests GROUP BY code",
)
register(
    "apply_defaults",
    lambda d: model.apply_defaults(_typed_updates(d).drop("request_id"), "products", now=NOW).select(
        "id", "code", "weight", "is_active", "created_at", "updated_at"),
    f"SELECT request_id + {BIG} AS id, code, cast(coalesce(try_cast(weight AS decimal(8,2)), 0) AS decimal(8,2)) AS weight, true AS is_active, {NOW_SQL} AS created_at, {NOW_SQL} AS updated_at FROM product_requests",
)
register(
    "ensure_columns",
    lambda d: model.ensure_columns(d.clients.select("id", "name"), "clients").select("id", "name", "telegram", "installment_term", "showcase", "updated_at", "created_by"),
    f"""SELECT id, name, {nulls('varchar', 'telegram')}, {nulls('int', 'installment_term')}, {nulls('boolean', 'showcase')}, {nulls('timestamp', 'updated_at')},
        {nulls('bigint', 'created_by')} FROM clients""",
)


def _stored(d):
    """All ten tables written as a snapshot and loaded back with the declared schema."""
    tables = {}
    for name in model.SCHEMAS:
        wanted = model.schema(name)
        tables[name] = d[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    folder = snapshots.snapshot_tables(tables, scratch_path(d.spark, "snapshot"), NOW)
    return model.load_tables(d.spark, folder)


register(
    "load_tables", lambda d: _stored(d)["invoices"].select("id", "number", "date", "client_id", "vat_rate", "total", "status", "is_paid", "created_at"),
    "SELECT cast(id AS varchar) AS id, number, date, cast(client_id AS varchar) AS client_id, vat_rate, total, status, is_paid, created_at FROM invoices",
)


def _counted(d):
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in _stored(d).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


register("snapshot_tables", _counted, union([f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in model.SCHEMAS]))


def _manifest(d):
    """One snapshot per day with invoices, taken that day."""
    return d.invoices.select(F.col("date").cast("string").alias("snapshot"), F.col("created_at").alias("taken_at")).distinct()


register(
    "expired_snapshots", lambda d: snapshots.expired_snapshots(_manifest(d), dt.datetime(2001, 5, 20, 12), 30),
    """WITH m AS (SELECT DISTINCT cast(date AS varchar) AS snapshot, created_at AS taken_at FROM invoices),
         flagged AS (SELECT snapshot, taken_at, floor((epoch(TIMESTAMP '2001-05-20 12:00:00') - epoch(taken_at)) / 86400) > 30 AS expired FROM m)
       SELECT snapshot, taken_at, expired, (SELECT count(*) FROM flagged WHERE NOT expired) AS remaining FROM flagged""",
)
