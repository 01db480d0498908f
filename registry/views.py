"""The ten tables and the request tables, stated as views over the driver's Parquet tables.

The same text runs in Spark and in DuckDB. ``Data`` resolves views on the Spark side, one DataFrame
per name and only for the names asked for; ``with_views`` writes them as CTEs in front of an oracle
query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tradebook.session import configure, size_shuffles
from tradebook.sources.model import SCHEMAS, ensure_columns

# Declared, so that no job has to look into the files for the columns.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,
        o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
DRIVER_TABLES = tuple(DRIVER_SCHEMAS)

VIEWS: dict[str, str] = {}

VIEWS["clients"] = """
SELECT c.c_custkey AS id, c.c_name AS name, concat(c.c_name, ' DOO') AS legal_name,
       lpad(cast(c.c_custkey AS string), 8, '0') AS mb,
       cast(c.c_custkey + 100000000 AS string) AS pib,
       concat(n.n_name, ', ', r.r_name) AS address, n.n_name AS city, r.r_name AS municipality,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE concat('c', cast(c.c_custkey AS string), '@example.com') END AS email,
       (c.c_acctbal < 0) AS installment_payment, CASE WHEN c.c_acctbal < 0 THEN 30 END AS installment_term,
       (c.c_mktsegment = 'FURNITURE') AS showcase, (c.c_mktsegment = 'BUILDING') AS bar
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["products"] = """
SELECT p_partkey AS id, concat('P', lpad(cast(p_partkey AS string), 8, '0')) AS code, p_name AS name,
       cast(p_retailprice AS decimal(10,2)) AS price,
       cast(CASE WHEN p_size <= 5 THEN 0 ELSE p_size * 10 END AS decimal(8,2)) AS weight,
       CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN '' ELSE p_type END AS category,
       (p_partkey % 10 <> 0) AS is_active
FROM part
"""

VIEWS["invoices"] = """
SELECT id, number, date, due_date, client_id, cast(20 AS decimal(5,2)) AS vat_rate, subtotal, vat_amount,
       cast(subtotal + vat_amount AS decimal(12,2)) AS total, status, is_delivered, is_paid, notes, created_at
FROM (SELECT o_orderkey AS id, concat('INV-', lpad(cast(o_orderkey AS string), 8, '0')) AS number,
             cast(o_orderdate AS date) AS date, cast(o_orderdate + INTERVAL 30 DAY AS date) AS due_date,
             o_custkey AS client_id, cast(o_totalprice AS decimal(12,2)) AS subtotal,
             cast(cast(o_totalprice AS decimal(12,2)) * cast(0.20 AS decimal(4,2)) AS decimal(12,2)) AS vat_amount,
             CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'draft' END AS status,
             (o_orderstatus <> 'O') AS is_delivered,
             (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS is_paid,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('note, "', o_orderpriority, '"') END AS notes,
             o_orderdate AS created_at
      FROM orders) t
"""

# The five columns together name a line, so ids need no numbering of the lines of an order.
VIEWS["invoice_items"] = """
SELECT concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string),
                 cast(cast(l_extendedprice AS decimal(10,2)) AS string)) AS id,
       l_orderkey AS invoice_id, l_partkey AS product_id, cast(l_quantity AS int) AS quantity,
       cast(l_extendedprice AS decimal(10,2)) AS unit_price,
       cast(cast(l_extendedprice AS decimal(10,2)) * cast(l_quantity AS int) AS decimal(12,2)) AS total_price,
       l_shipdate AS created_at
FROM lineitem
"""

VIEWS["deliveries"] = """
SELECT o_orderkey AS id, concat('DEL-', lpad(cast(o_orderkey AS string), 8, '0')) AS number,
       cast(o_orderdate AS date) AS date, cast(o_orderdate + INTERVAL 14 DAY AS date) AS due_date,
       o_custkey AS client_id, o_orderpriority AS delivery_method,
       CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'draft' END AS status,
       (o_orderpriority = '1-URGENT') AS is_signed, cast(NULL AS string) AS notes, o_orderdate AS created_at
FROM orders WHERE o_orderstatus <> 'O'
"""

VIEWS["delivery_items"] = """
SELECT i.id, i.invoice_id AS delivery_id, i.product_id, i.quantity, 'kom' AS unit, i.created_at
FROM invoice_items i JOIN deliveries d ON i.invoice_id = d.id
"""

VIEWS["product_groups"] = """
SELECT id, name, quantity_type, original_quantity,
       cast(greatest(cast(0 AS decimal(14,4)), cast(original_quantity * cast(0.95 AS decimal(3,2)) - reservation_amount AS decimal(14,4))) AS decimal(12,2)) AS current_quantity,
       shipment_date, quantity_type AS reservation_type, reservation_amount, created_at
FROM (SELECT id, name, CASE WHEN id % 2 = 0 THEN 'weight' ELSE 'units' END AS quantity_type,
             cast(CASE id % 3 WHEN 0 THEN 900000000 WHEN 1 THEN 400000 ELSE 5000000 END AS decimal(12,2)) AS original_quantity,
             cast(TIMESTAMP '1995-01-01 00:00:00' + INTERVAL 1 DAY AS date) AS shipment_date,
             cast(1000 * (id % 5) AS decimal(12,2)) AS reservation_amount,
             cast('1995-01-01 00:00:00' AS timestamp) AS created_at
      FROM (SELECT DISTINCT cast(substring(p_brand, 7) AS int) AS id, p_brand AS name FROM part) b) g
"""

VIEWS["product_group_items"] = """
SELECT p_partkey AS id, cast(substring(p_brand, 7) AS int) AS group_id, p_partkey AS product_id
FROM part WHERE p_size > 5 AND p_type <> 'PROMO'
"""

VIEWS["users"] = """
SELECT c_custkey AS id, concat('user_', cast(c_custkey AS string)) AS username, c_name AS full_name,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, (c_custkey % 11 <> 0) AS is_active,
       concat('{"clients":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END,
              ',"statistics":', CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END, '}') AS permissions,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('u', cast(c_custkey AS string), '@example.com') END AS email
FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
"""

VIEWS["activity_logs"] = """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
       CASE event_type WHEN 'click' THEN 'VIEW_CLIENT' WHEN 'view' THEN 'VIEW_PRODUCT' WHEN 'purchase' THEN 'CREATE_INVOICE'
                       WHEN 'signup' THEN 'User registered' ELSE 'SYSTEM_ERROR' END AS action,
       CASE event_type WHEN 'click' THEN 'client' WHEN 'view' THEN 'product' WHEN 'purchase' THEN 'invoice' WHEN 'signup' THEN 'user' END AS entity_type,
       user_id AS entity_id, props AS details, concat('10.0.0.', cast(user_id % 250 AS string)) AS ip_address, ts AS created_at
FROM events
"""

# Request tables: one request per row of a whole driver table, raw text as a client would send it.

VIEWS["client_requests"] = """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE concat('New ', c_name) END AS name, concat(c_name, ' LLC') AS legal_name,
       CASE WHEN c_custkey % 17 = 0 THEN lpad(cast(c_custkey AS string), 8, '0') WHEN c_custkey % 19 = 0 THEN 'DUP-MB'
            ELSE concat('N', lpad(cast(c_custkey AS string), 8, '0')) END AS mb,
       CASE WHEN c_custkey % 23 = 0 THEN cast(c_custkey + 100000000 AS string) WHEN c_custkey % 5 = 0 AND c_custkey % 19 < 2 THEN 'DUP-PIB'
            ELSE cast(c_custkey + 500000000 AS string) END AS pib,
       'Main street 1' AS address,
       CASE WHEN c_custkey % 11 = 0 THEN 'not-an-email' WHEN c_custkey % 7 = 0 THEN NULL
            ELSE concat('N', cast(c_custkey AS string), '@Example.COM') END AS email,
       CASE WHEN c_custkey % 29 = 0 THEN '0' WHEN c_custkey % 31 = 0 THEN 'x' WHEN c_custkey % 41 = 0 THEN '3000000000' WHEN c_custkey % 2 = 0 THEN '30' END AS installment_term,
       CASE WHEN c_custkey % 37 = 0 THEN 'htp:/bad' ELSE 'https://maps.example.com/x' END AS google_maps_link
FROM customer
"""

VIEWS["product_requests"] = """
SELECT p_partkey AS request_id,
       CASE WHEN p_partkey % 13 = 0 THEN concat('P', lpad(cast(p_partkey AS string), 8, '0')) WHEN p_partkey % 19 = 0 THEN 'DUP'
            ELSE concat('X', lpad(cast(p_partkey AS string), 8, '0')) END AS code,
       CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name,
       CASE WHEN p_partkey % 11 = 0 THEN '-1' WHEN p_partkey % 23 = 0 THEN 'abc' WHEN p_partkey % 31 = 0 THEN '12345678901'
            ELSE cast(cast(p_retailprice AS decimal(10,2)) AS string) END AS price,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN '1e9' ELSE cast(p_size AS string) END AS weight,
       CASE WHEN p_partkey % 29 = 0 THEN 'maybe' ELSE 'true' END AS is_active
FROM part
"""

VIEWS["invoice_requests"] = """
SELECT o_orderkey AS request_id,
       CASE WHEN o_orderkey % 13 = 0 THEN concat('INV-', lpad(cast(o_orderkey AS string), 8, '0')) WHEN o_orderkey % 19 = 0 THEN 'DUP'
            ELSE concat('NEW-', lpad(cast(o_orderkey AS string), 8, '0')) END AS number,
       CASE WHEN o_orderkey % 17 = 0 THEN '2001-13-45' ELSE cast(cast(o_orderdate AS date) AS string) END AS date,
       cast(cast(o_orderdate + INTERVAL 30 DAY AS date) AS string) AS due_date,
       CASE WHEN o_orderkey % 43 = 0 THEN -1 ELSE o_custkey END AS client_id,
       CASE WHEN o_orderkey % 11 = 0 THEN '120' ELSE '20' END AS vat_rate
FROM orders
"""

VIEWS["invoice_request_lines"] = """
SELECT invoice_id AS request_id, id AS line_no,
       CASE WHEN (product_id + invoice_id) % 47 = 0 THEN -1 ELSE product_id END AS product_id,
       CASE WHEN (product_id + invoice_id) % 31 = 0 THEN '0' WHEN (product_id + invoice_id) % 101 = 0 THEN '99999999999'
            WHEN (product_id + invoice_id) % 103 = 0 THEN '2000000000' ELSE cast(quantity AS string) END AS quantity,
       CASE WHEN (product_id + invoice_id) % 37 = 0 THEN '-5' WHEN (product_id + invoice_id) % 107 = 0 THEN '1e30' ELSE cast(unit_price AS string) END AS unit_price,
       CASE WHEN product_id % 2 = 0 THEN NULL ELSE 'kg' END AS unit
FROM invoice_items
"""

VIEWS["delivery_requests"] = """
SELECT request_id, replace(number, 'INV-', 'DEL-') AS number, date, due_date, client_id FROM invoice_requests
"""

VIEWS["status_requests"] = """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_orderkey END AS id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'draft' ELSE 'confirmed' END AS status,
       CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag_a, CASE WHEN o_orderkey % 2 = 0 THEN true END AS flag_b
FROM orders
UNION ALL
SELECT o_orderkey + 10000000000, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'draft' END, NULL, false
FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL
SELECT o_orderkey + 20000000000, o_orderkey, 'confirmed', true, NULL
FROM orders WHERE o_orderpriority = '1-URGENT'
"""

VIEWS["group_requests"] = """
SELECT p_partkey AS request_id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('Group ', p_name) END AS name,
       CASE WHEN p_partkey % 7 = 0 THEN 'boxes' WHEN p_partkey % 2 = 0 THEN 'weight' ELSE 'units' END AS quantity_type,
       CASE WHEN p_partkey % 11 = 0 THEN '0' WHEN p_partkey % 37 = 0 THEN '1e30' ELSE cast(cast(p_retailprice AS decimal(10,2)) AS string) END AS original_quantity,
       CASE WHEN p_partkey % 17 = 0 THEN '2024-02-30' ELSE '2024-02-29' END AS shipment_date,
       'weight' AS reservation_type,
       CASE WHEN p_partkey % 19 = 0 THEN '-3' WHEN p_partkey % 3 = 0 THEN cast(p_size * 40 AS string) END AS reservation_amount
FROM part
"""

VIEWS["group_product_requests"] = """
SELECT p_partkey AS request_id,
       CASE WHEN p_partkey % 9 = 0 THEN 999 ELSE cast(substring(p_brand, 7) AS int) END AS group_id,
       CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 100000000 ELSE p_partkey END AS product_id
FROM part
UNION ALL
SELECT p_partkey + 10000000000, cast(substring(p_brand, 7) AS int) % 25 + 1, p_partkey FROM part WHERE p_type = 'PROMO'
"""

VIEWS["user_requests"] = """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 13 = 0 THEN concat('user_', cast(c_custkey AS string)) WHEN c_custkey % 17 = 0 THEN 'ab'
            WHEN c_custkey % 19 = 0 THEN 'bad name!' WHEN c_custkey % 23 = 0 THEN 'twin' ELSE concat('new_', cast(c_custkey AS string)) END AS username,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'shared@example.com'
            ELSE concat('u', cast(c_custkey + 100 AS string), '@example.com') END AS email,
       c_name AS full_name
FROM customer
"""

# Unchecked loads: the tables with the raw requests added, so constraint scans have something to find.

VIEWS["staged_users"] = """
SELECT id, username, email, full_name, role FROM users
UNION ALL
SELECT request_id + 10000000000, CASE WHEN request_id % 71 = 0 THEN NULL ELSE username END, email, full_name,
       CASE WHEN request_id % 61 = 0 THEN 'guest' ELSE 'user' END FROM user_requests
"""

VIEWS["staged_clients"] = """
SELECT id, name, legal_name, mb, pib, address, cast(NULL AS bigint) AS created_by FROM clients
UNION ALL
SELECT request_id + 10000000000, nullif(trim(name), ''), legal_name, CASE WHEN request_id % 53 = 0 THEN concat(mb, mb, mb) ELSE mb END, pib, address,
       request_id FROM client_requests
"""

VIEWS["staged_products"] = """
SELECT id, code, name, price, weight, category FROM products
UNION ALL
SELECT request_id + 10000000000, code, nullif(name, ''), try_cast(price AS decimal(10,2)), try_cast(weight AS decimal(8,2)), NULL FROM product_requests
"""

VIEWS["staged_invoices"] = """
SELECT id, number, date, due_date, client_id, vat_rate, subtotal, vat_amount, total, status FROM invoices
UNION ALL
SELECT request_id + 10000000000, number, try_cast(date AS date), try_cast(due_date AS date), client_id, try_cast(vat_rate AS decimal(5,2)),
       cast(request_id % 7 - 1 AS decimal(12,2)), cast(0 AS decimal(12,2)), cast(0 AS decimal(12,2)),
       CASE WHEN request_id % 59 = 0 THEN 'sent' ELSE 'draft' END FROM invoice_requests
"""

VIEWS["staged_invoice_items"] = """
SELECT id, invoice_id, product_id, quantity, unit_price, total_price FROM invoice_items
UNION ALL
SELECT concat('new-', line_no), request_id + 10000000000, product_id, try_cast(quantity AS int), try_cast(unit_price AS decimal(10,2)),
       try_cast(try_cast(unit_price AS decimal(10,2)) * try_cast(quantity AS int) + CASE WHEN product_id % 5 = 0 THEN 1 ELSE 0 END AS decimal(12,2)) FROM invoice_request_lines
"""

VIEWS["staged_deliveries"] = """
SELECT id, number, date, due_date, client_id, status FROM deliveries
UNION ALL
SELECT request_id + 10000000000, number, try_cast(date AS date), try_cast(due_date AS date), client_id, 'draft' FROM delivery_requests
"""

VIEWS["staged_delivery_items"] = """
SELECT id, delivery_id, product_id, quantity, unit FROM delivery_items
UNION ALL
SELECT concat('new-', line_no), request_id + 10000000000, product_id, try_cast(quantity AS int), unit FROM invoice_request_lines
"""

VIEWS["staged_product_groups"] = """
SELECT cast(id AS bigint) AS id, name, quantity_type, original_quantity, current_quantity, shipment_date, reservation_type, reservation_amount FROM product_groups
UNION ALL
SELECT request_id + 10000000000, nullif(name, ''), quantity_type, try_cast(original_quantity AS decimal(12,2)), cast(0 AS decimal(12,2)),
       try_cast(shipment_date AS date), reservation_type, try_cast(reservation_amount AS decimal(12,2)) FROM group_requests
"""

VIEWS["staged_product_group_items"] = """
SELECT id, cast(group_id AS bigint) AS group_id, product_id FROM product_group_items
UNION ALL
SELECT request_id + 10000000000, group_id, product_id FROM group_product_requests
"""

VIEWS["staged_activity_logs"] = """
SELECT id, CASE WHEN id % 101 = 0 THEN -5 ELSE user_id END AS user_id, CASE WHEN id % 103 = 0 THEN NULL ELSE action END AS action, entity_type FROM activity_logs
"""

_NAMES = DRIVER_TABLES + tuple(VIEWS)


def reads(sql: str) -> list[str]:
    """Names of the tables and views a text mentions after FROM or JOIN."""
    found = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql)
    return [n for n in dict.fromkeys(found) if n in _NAMES]


def _needed(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name in reads(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen[name] = None
    return seen


def with_views(sql: str) -> str:
    """Prefix an oracle query with the CTEs it reads."""
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql, {})]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        ctes, body = [*ctes, body[5:]], None
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Data:
    """DataFrames of one scale folder by name: ``data.invoices``, ``data.orders``, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._ready: dict[str, DataFrame] = {}
        self._named: set[str] = set()
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            df = self._plain(name)
            self._ready[name] = ensure_columns(df, name) if name in SCHEMAS else df
        return self._ready[name]

    __getattr__ = __getitem__

    def _plain(self, name: str) -> DataFrame:
        """The table or view as its text gives it."""
        if name not in VIEWS:
            reader = self.spark.read
            if name in DRIVER_SCHEMAS:
                reader = reader.schema(DRIVER_SCHEMAS[name])
            df = reader.parquet(f"{self.sf_dir}/{name}.parquet")
            self._read[name] = df
            size_shuffles(self.spark, *self._read.values())
            return df
        sql = VIEWS[name]
        for source in reads(sql):
            sql = re.sub(rf"\b(FROM|JOIN)\s+{source}\b", rf"\1 {self._view(source)}", sql)
        return self.spark.sql(sql)

    def _view(self, name: str) -> str:
        """Register a source under a name of its own, once."""
        if name not in self._named:
            self._plain(name).createOrReplaceTempView(f"tradebook_{name}")
            self._named.add(name)
        return f"tradebook_{name}"
