"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tradebook.sources.model import SCHEMAS, ensure_columns

NOW = dt.datetime(2024, 3, 1, 12)


def frame(spark, table, rows, columns=None):
    """Rows as dicts; columns the dicts lack become NULL."""
    fields = {}
    for part in SCHEMAS[table].replace("\n", " ").split(", "):
        name, kind = part.split()
        fields[name] = kind
    used = columns or list(dict.fromkeys(k for r in rows for k in r))
    ddl = ", ".join(f"{c} {fields[c]}" for c in used)
    return ensure_columns(spark.createDataFrame([tuple(r.get(c) for c in used) for r in rows], ddl), table)


def seed(spark):
    """One client, three products, one group holding the first two, no invoices."""
    return {
        "users": frame(spark, "users", [{"id": "u1", "username": "boss", "role": "admin", "is_active": True, "permissions": "{}"}]),
        "clients": frame(spark, "clients", [{
            "id": "c1", "name": "Sample Client", "legal_name": "Sample Client LLC", "mb": "12345678", "pib": "987654321",
            "address": "123 Sample Street, Sample City"}]),
        "products": frame(spark, "products", [
            {"id": f"p{i}", "code": f"PROD00{i}", "name": f"Sample Product {i}", "price": Decimal(50 + 50 * i),
             "weight": Decimal(250 + 250 * i), "is_active": True} for i in (1, 2, 3)]),
        "product_groups": frame(spark, "product_groups", [{
            "id": "g1", "name": "Sample Group", "quantity_type": "weight", "original_quantity": Decimal(10000),
            "current_quantity": Decimal(9000), "shipment_date": dt.date(2024, 1, 1), "reservation_type": "weight",
            "reservation_amount": Decimal(500)}]),
        "product_group_items": frame(spark, "product_group_items", [
            {"id": "b1", "group_id": "g1", "product_id": "p1"}, {"id": "b2", "group_id": "g1", "product_id": "p2"}]),
        "invoices": frame(spark, "invoices", [], ["id", "number", "client_id", "status", "date", "total", "created_at"]),
        "invoice_items": frame(spark, "invoice_items", [], ["id", "invoice_id", "product_id", "quantity"]),
        "deliveries": frame(spark, "deliveries", [], ["id", "number", "client_id", "status", "date", "created_at"]),
        "delivery_items": frame(spark, "delivery_items", [], ["id", "delivery_id", "product_id", "quantity"]),
        "activity_logs": frame(spark, "activity_logs", [], ["id", "user_id", "action", "created_at"]),
    }


def rows(df, *columns, order=None):
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=lambda r: tuple(str(v) for v in r)) if order is None else got
