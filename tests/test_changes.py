"""Change sets on small tables, against the outcome of taking requests one by one."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.small import NOW, frame, rows, seed
from tradebook.operators import changes, documents, registers, stock
from tradebook.operators.search import by_ids


def requests(spark, ddl, *data):
    return spark.createDataFrame(list(data), "request_id string, " + ddl)


def reasons(change):
    return dict(rows(change.rejected, "request_id", "reason"))


HEAD = "number string, date string, due_date string, client_id string, vat_rate string, actor_id string, ip_address string"
LINE = "line_no string, product_id string, quantity string, unit_price string, unit string"


@pytest.fixture
def t(spark):
    return seed(spark)


def test_create_invoices(spark, t):
    heads = requests(
        spark, HEAD,
        ("r1", " A1 ", "2024-01-01", "2024-02-01", "c1", "20", "u1", "::1"),
        ("r2", "A1", "2024-01-01", "2024-02-01", "c1", "20", None, None),
        ("r3", "A3", "2024-01-01", "2024-02-01", "zz", "20", None, None),
        ("r4", "A4", "2024-01-01", "2024-02-01", "c1", "120", None, None),
        ("r5", "A5", "2024-01-01", "2024-02-01", "c1", "20", None, None),
        ("r6", "A6", "2024-01-01", "2024-02-01", "c1", "20", None, None),
        ("r0", "A3", "2024-13-01", "2024-02-01", "c1", "20", None, None))
    lines = requests(
        spark, LINE, ("r1", "1", "p1", "2", "100.00", None), ("r1", "2", "p2", "1", "150", None),
        *[(r, "1", "p1", "1", "1", None) for r in ("r0", "r2", "r3", "r4")], ("r5", "1", "nope", "1", "1", None))
    made = documents.create_invoices(t, heads, lines, NOW)
    assert reasons(made) == {"r0": "invalid", "r2": "duplicate_number", "r3": "unknown_client", "r4": "invalid",
                             "r5": "unknown_product", "r6": "invalid"}
    assert rows(made.tables["invoices"], "number", "subtotal", "vat_amount", "total", "status", "created_at") == [
        ("A1", Decimal("350.00"), Decimal("70.00"), Decimal("420.00"), "draft", NOW)]
    head, items = made.rows["invoices"].collect()[0], made.rows["invoice_items"].collect()
    assert len(items) == 2 and {i["invoice_id"] for i in items} == {head["id"]}
    entry = made.activity.collect()[0]
    assert (entry["user_id"], entry["ip_address"], entry["action"], entry["entity_id"]) == ("u1", "127.0.0.1", "CREATE_INVOICE", head["id"])
    assert '"item_count":2' in entry["details"] and '"timestamp":"2024-03-01T12:00:00.000Z"' in entry["details"]
    again = documents.create_invoices({**t, "invoices": made.tables["invoices"]}, heads, lines, NOW)
    assert reasons(again)["r1"] == "duplicate_number"


def test_unit_prices_are_summed_before_rounding(spark, t):
    heads = requests(spark, HEAD, ("r1", "A1", "2024-01-01", "2024-02-01", "c1", "20", None, None))
    lines = requests(spark, LINE, *[("r1", str(i), "p1", "1", "0.005", None) for i in range(3)])
    made = documents.create_invoices(t, heads, lines, NOW)
    assert rows(made.rows["invoices"], "subtotal", "vat_amount", "total") == [(Decimal("0.02"), Decimal("0.00"), Decimal("0.02"))]


def test_create_deliveries_fills_the_unit(spark, t):
    heads = requests(spark, HEAD, ("r1", "D1", "2024-01-01", "2024-02-01", "c1", None, None, None))
    lines = requests(spark, LINE, ("r1", "1", "p1", "2", None, None), ("r1", "2", "p1", "2", None, ""), ("r1", "3", "p2", "1", None, "kg"))
    made = documents.create_deliveries(t, heads, lines, NOW)
    assert sorted(r["unit"] for r in made.rows["delivery_items"].collect()) == ["kg", "ком", "ком"]
    assert rows(made.rows["deliveries"], "number", "status", "is_signed") == [("D1", "draft", False)]


@pytest.fixture
def billed(spark, t):
    t["invoices"] = frame(spark, "invoices", [
        {"id": i, "number": i.upper(), "client_id": "c1", "status": s, "date": dt.date(2024, 1, n), "is_paid": False}
        for n, (i, s) in enumerate([("v1", "draft"), ("v2", "confirmed"), ("v3", "draft")], 1)])
    t["invoice_items"] = frame(spark, "invoice_items", [
        {"id": f"{v}-{p}", "invoice_id": v, "product_id": p, "quantity": 1} for v in ("v1", "v2", "v3") for p in ("p1", "p3")])
    return t


def test_status_changes_deduct_on_every_entry_into_confirmed(spark, billed):
    asked = requests(spark, "id string, status string",
                     ("r1", "v1", "confirmed"), ("r2", "v1", "draft"), ("r3", "v1", "confirmed"), ("r4", "v2", "confirmed"),
                     ("r5", "v3", "paid"), ("r6", "v9", "draft"), ("r7", "v2", "draft"))
    made = documents.set_invoice_status(billed, asked, NOW)
    assert reasons(made) == {"r5": "invalid", "r6": "not_found"}
    assert rows(made.tables["invoices"], "id", "status", "updated_at") == [
        ("v1", "confirmed", NOW), ("v2", "draft", NOW), ("v3", "draft", None)]
    assert rows(made.tables["product_groups"], "current_quantity") == [(Decimal("8000.00"),)]
    steps = [r for r in made.activity.collect() if r["entity_type"] == "invoices"]
    assert {(r["request_id"], r["action"]) for r in steps} >= {("r2", "UPDATE_INVOICE_STATUS_DRAFT"), ("r4", "UPDATE_INVOICE_STATUS_CONFIRMED")}
    assert '"old_status":"confirmed","new_status":"confirmed"' in next(r["details"] for r in steps if r["request_id"] == "r4")
    moved = [r for r in made.activity.collect() if r["entity_type"] == "product_groups"]
    assert sorted(r["request_id"] for r in moved) == ["r1", "r3"]
    assert all(r["action"] == "UPDATE_STOCK_ON_INVOICE_CONFIRMATION" and '"weight_used":500' in r["details"] for r in moved)


def test_delivery_log_tells_the_true_old_status(spark, t):
    t["deliveries"] = frame(spark, "deliveries", [{"id": "d1", "number": "D", "client_id": "c1", "status": "draft"}])
    made = documents.set_delivery_status(t, requests(spark, "id string, status string", ("r1", "d1", "confirmed")), NOW)
    assert '"old_status":"draft","new_status":"confirmed"' in made.activity.collect()[0]["details"]


def test_status_steps_equal_the_loop(spark):
    rng = random.Random(5)
    base = [(f"v{i}", rng.choice(["draft", "confirmed"]), dt.date(2024, 1, 1)) for i in range(6)]
    asked = [(f"r{n:03}", f"v{0 if rng.random() < 0.6 else rng.randrange(6)}", rng.choice(["draft", "confirmed"])) for n in range(150)]
    now, want = {i: s for i, s, _ in base}, []
    for r, i, s in asked:
        want.append((r, i, now[i], s))
        now[i] = s
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = documents.status_steps(spark.createDataFrame(base, "id string, status string, date date"),
                                 spark.createDataFrame(asked, "request_id string, id string, status string"))
    assert rows(got, "request_id", "id", "old_status", "status") == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_tracking_is_a_sparse_patch(spark, billed):
    asked = requests(spark, "id string, is_delivered boolean, is_paid boolean",
                     ("r1", "v1", True, None), ("r2", "v1", None, True), ("r3", "v1", False, None), ("r4", "v2", None, None), ("r5", "v8", True, None))
    made = documents.set_invoice_tracking(billed, asked, NOW)
    assert reasons(made) == {"r4": "no_fields", "r5": "not_found"}
    assert rows(made.rows["invoices"], "id", "is_delivered", "is_paid") == [("v1", False, True)]


def test_only_drafts_are_deleted_with_their_items(spark, billed):
    asked = requests(spark, "id string", ("r1", "v1"), ("r2", "v2"), ("r3", "v1"), ("r4", "v7"))
    made = documents.delete_invoices(billed, asked, NOW)
    assert reasons(made) == {"r2": "confirmed", "r3": "not_found", "r4": "not_found"}
    assert rows(made.tables["invoices"], "id") == [("v2",), ("v3",)]
    assert {r["invoice_id"] for r in made.tables["invoice_items"].collect()} == {"v2", "v3"}
    assert '"number":"V1"' in made.activity.collect()[0]["details"]


CLIENT = "name string, legal_name string, mb string, pib string, address string, email string"


def test_create_clients_frees_the_other_key_of_a_refused_request(spark, t):
    asked = requests(
        spark, CLIENT, ("r1", "A", "A", "m1", "x1", "a", None), ("r2", "B", "B", "m1", "x2", "a", None),
        ("r3", "C", "C", "m3", "x2", "a", "Q@Gmail.com"), ("r4", "D", "D", "12345678", "x4", "a", None),
        ("r5", "E", "E", "m5", "x4", "a", None), ("r6", " ", "F", "m6", "x6", "a", None), ("r7", "G", "G", "m6", "x6", "a", None))
    made = registers.create_clients(t, asked, NOW)
    assert reasons(made) == {"r2": "duplicate", "r4": "duplicate", "r6": "invalid"}
    assert rows(made.rows["clients"], "name", "email", "bar") == [
        ("A", None, False), ("C", "q@gmail.com", False), ("E", None, False), ("G", None, False)]
    assert rows(made.activity, "action")[0] == ("Created client: A",)


def test_update_clients(spark, t):
    t["clients"] = t["clients"].unionByName(frame(spark, "clients", [
        {"id": "c2", "name": "Two", "legal_name": "T", "mb": "22", "pib": "23", "address": "a", "city": "old", "bar": True}]))
    asked = spark.createDataFrame([
        ("r1", "c2", "New", "N", "22", "24", "b", None), ("r2", "c2", "Late", "N", "22", "24", "b", None),
        ("r3", "c1", "Clash", "N", "22", "99", "b", None), ("r4", "c9", "None", "N", "77", "78", "b", None)],
        "request_id string, id string, " + CLIENT)
    made = registers.update_clients(t, asked, NOW)
    assert reasons(made) == {"r3": "duplicate", "r4": "not_found"}
    assert rows(made.rows["clients"], "id", "name", "pib", "city", "bar", "updated_at") == [("c2", "Late", "24", None, False, NOW)]
    assert made.tables["clients"].count() == 2


def test_delete_clients(spark, billed):
    billed["clients"] = billed["clients"].unionByName(frame(spark, "clients", [{"id": "c2", "name": "Free", "mb": "2", "pib": "2"}]))
    made = registers.delete_clients(billed, requests(spark, "id string", ("r1", "c1"), ("r2", "c2"), ("r3", "c2"), ("r4", "c5")), NOW)
    assert rows(made.rejected, "request_id", "reason", "invoice_count", "delivery_count") == [
        ("r1", "in_use", 3, 0), ("r3", "not_found", None, None), ("r4", "not_found", None, None)]
    assert rows(made.tables["clients"], "id") == [("c1",)]


PRODUCT = "code string, name string, price string, weight string, is_active string"


def test_products(spark, billed):
    asked = requests(spark, PRODUCT, ("r1", "X", "n", "1.5", None, "false"), ("r2", "X", "n", "1", "2", None),
                     ("r3", "PROD001", "n", "1", "2", None), ("r4", "Y", "n", "abc", "2", None))
    made = registers.create_products(billed, asked, NOW)
    assert reasons(made) == {"r2": "duplicate_code", "r3": "duplicate_code", "r4": "invalid"}
    assert rows(made.rows["products"], "code", "price", "weight", "is_active") == [("X", Decimal("1.50"), Decimal("0.00"), True)]
    full = spark.createDataFrame([("r1", "p1", "PROD001", "new", "7", None, None), ("r2", "p2", "PROD001", "n", "7", None, None)],
                                 "request_id string, id string, " + PRODUCT)
    made = registers.update_products(billed, full, NOW)
    assert reasons(made) == {"r2": "duplicate_code"}
    assert rows(made.rows["products"], "id", "name", "price", "weight", "is_active") == [("p1", "new", Decimal("7.00"), Decimal("500.00"), True)]
    retired = registers.retire_products(billed, requests(spark, "id string", ("r1", "p1"), ("r2", "p2"), ("r3", "p2"), ("r4", "p1"), ("r5", "p8")), NOW)
    assert reasons(retired) == {"r3": "not_found", "r5": "not_found"}
    assert rows(retired.tables["products"], "id", "is_active") == [("p1", False), ("p3", True)]
    assert rows(retired.tables["product_group_items"], "product_id") == [("p1",)]
    assert ("r2", "Deleted product: Sample Product 2 (PROD002)") in rows(retired.activity, "request_id", "action")
    back = registers.activate_products({**billed, "products": retired.tables["products"]}, requests(spark, "id string", ("r1", "p1")), NOW)
    assert rows(back.rows["products"], "id", "is_active") == [("p1", True)]


def test_groups(spark, t):
    asked = requests(
        spark, "name string, quantity_type string, original_quantity string, shipment_date string, reservation_type string, reservation_amount string",
        ("r1", "G", "units", "10000", "2024-01-01", "units", "500"), ("r2", "H", "boxes", "1", "2024-01-01", "units", None),
        ("r3", "I", "weight", "100", "2024-01-01T00:00:00Z", "weight", None))
    made = registers.create_groups(t, asked, NOW)
    assert reasons(made) == {"r2": "invalid"}
    assert rows(made.rows["product_groups"], "name", "current_quantity", "reservation_amount") == [
        ("G", Decimal("9000.00"), Decimal("500.00")), ("I", Decimal("95.00"), Decimal("0.00"))]
    patch = requests(spark, "id string, original_quantity string, name string, current_quantity string",
                     ("r1", "g1", "50", None, "1"), ("r2", "g1", None, "Renamed", None), ("r3", "g1", None, None, "5"), ("r4", "g1", "-5", None, None))
    made = registers.patch_groups(t, patch, NOW)
    assert reasons(made) == {"r3": "no_fields", "r4": "invalid"}
    assert rows(made.rows["product_groups"], "name", "original_quantity", "current_quantity") == [("Renamed", Decimal("50.00"), Decimal("9000.00"))]
    pairs = "group_id string, product_id string"
    made = registers.add_group_products(t, requests(spark, pairs, ("r1", "g1", "p3"), ("r2", "g1", "p3"), ("r3", "g1", "p1"), ("r4", "g9", "p3"), ("r5", "g1", "p9")), NOW)
    assert reasons(made) == {"r2": "already_grouped", "r3": "already_grouped", "r4": "group_not_found", "r5": "product_not_found"}
    assert '"product_code":"PROD003"' in made.activity.collect()[0]["details"]
    made = registers.remove_group_products(t, requests(spark, pairs, ("r1", "g1", "p1"), ("r2", "g1", "p1"), ("r3", "g1", "p3")), NOW)
    assert reasons(made) == {"r2": "not_in_group", "r3": "not_in_group"}
    assert rows(made.tables["product_group_items"], "product_id") == [("p2",)]
    made = registers.delete_groups(t, requests(spark, "id string", ("r1", "g1"), ("r2", "g2")), NOW)
    assert reasons(made) == {"r2": "not_found"} and made.tables["product_group_items"].count() == 0


def test_users(spark, t):
    asked = requests(spark, "username string, email string, full_name string, role string",
                     ("r1", "boss", None, None, None), ("r2", "new_1", "a@b.co", None, None), ("r3", "new_2", "A@b.co", None, None),
                     ("r4", "new_3", None, None, "admin"), ("r5", "new_4", None, None, "root"), ("r6", "имя_1", None, None, None))
    made = registers.create_users(t, asked, NOW)
    assert reasons(made) == {"r1": "duplicate", "r3": "duplicate", "r5": "invalid"}
    assert rows(made.rows["users"], "username", "role", "is_active", "permissions") == [
        ("new_1", "user", True, "{}"), ("new_3", "admin", True, "{}"), ("имя_1", "user", True, "{}")]
    users = {**t, "users": frame(spark, "users", [{"id": f"u{i}", "username": f"n{i}", "email": f"e{i}@x.co", "is_active": True} for i in (1, 2, 3)])}
    patch = requests(spark, "id string, email string, full_name string",
                     ("r1", "u1", "e1@x.co", None), ("r2", "u2", "e1@x.co", None), ("r3", "u3", "n@x.co", "N"), ("r4", "u1", "n@x.co", None), ("r5", "u1", None, None))
    made = registers.patch_users(users, patch, NOW)
    assert reasons(made) == {"r2": "duplicate", "r4": "duplicate", "r5": "no_fields"}
    assert rows(made.rows["users"], "id", "email", "full_name") == [("u1", "e1@x.co", None), ("u3", "n@x.co", "N")]
    flips = requests(spark, "id string, actor_id string", ("r1", "u1", "u1"), ("r2", "u2", "u1"), ("r3", "u2", "u1"), ("r4", "u3", "u1"), ("r5", "u9", "u1"))
    made = registers.toggle_users(users, flips, NOW)
    assert reasons(made) == {"r1": "own_account", "r5": "not_found"}
    assert rows(made.tables["users"], "id", "is_active") == [("u1", True), ("u2", True), ("u3", False)]
    assert rows(made.activity, "request_id", "action")[:2] == [("r2", "User deactivated"), ("r3", "User activated")]
    users["activity_logs"] = frame(spark, "activity_logs", [{"id": "1", "user_id": "u3", "action": "x"}])
    made = registers.delete_users(users, flips, NOW)
    assert reasons(made) == {"r1": "own_account", "r3": "not_found", "r4": "in_use", "r5": "not_found"}
    assert rows(made.tables["users"], "id") == [("u1",), ("u3",)]


def test_log_cleanup(spark, t):
    logs = frame(spark, "activity_logs", [{"id": str(i), "action": "x", "created_at": NOW - dt.timedelta(days=i)} for i in (0, 89, 90, 91, 200)])
    with pytest.raises(ValueError):
        registers.cleanup_logs(logs, NOW, 0)
    with pytest.raises(ValueError):
        registers.cleanup_logs(logs, NOW, 366)
    made = registers.cleanup_logs(logs, NOW)
    kept = made.tables["activity_logs"]
    assert rows(kept.filter("action = 'x'"), "id") == [("0",), ("89",), ("90",)]
    entry = kept.filter("action = 'CLEANUP_OLD_LOGS'").collect()[0]
    assert entry["user_id"] is None and '"deletedCount":2' in entry["details"] and '"system":true' in entry["details"]


def test_ids_of_new_rows_do_not_change_between_runs(spark):
    df = spark.range(5).withColumnRenamed("id", "request_id")
    first, second = (rows(df.select(changes.string_ids("invoices").alias("id"))) for _ in range(2))
    assert first == second and len(set(first)) == 5 and len(first[0][0]) == 36
    assert first != rows(df.select(changes.string_ids("clients")))


def test_by_ids_takes_lists_and_frames(spark, t):
    assert rows(by_ids(t["products"], ["p1", "p9"]), "id") == [("p1",)]
    wanted = spark.createDataFrame([("p2",), ("p2",)], "product string")
    assert rows(by_ids(t["products"], wanted), "id") == [("p2",)]
    assert by_ids(t["products"], None).count() == 3


def test_touch(spark, t):
    got = changes.touch(t["products"], F.col("id") == "p1", NOW)
    assert rows(got, "id", "updated_at") == [("p1", NOW), ("p2", None), ("p3", None)]


def test_one_number_owning_a_third_of_a_batch(spark, t):
    data = [(f"r{n:04}", "HOT" if n % 3 == 0 else f"N{n}", "2024-01-01", "2024-02-01", "c1", "20", None, None) for n in range(600)]
    heads = requests(spark, HEAD, *data).repartition(6)
    lines = requests(spark, LINE, *[(r[0], "1", "p1", "1", "1", None) for r in data])
    made = documents.create_invoices(t, heads, lines, NOW)
    assert made.rows["invoices"].count() == 401 and made.rejected.count() == 199
    assert rows(made.rows["invoices"].filter("number = 'HOT'"), "total") == [(Decimal("1.20"),)]
    assert "r0000" not in reasons(made)


def test_values_no_column_takes_are_refused_alone(spark, t):
    heads = requests(
        spark, "number string, date string, due_date string, client_id string, vat_rate string",
        *[(f"r{i}", f"N{i}", "2024-01-01", "2024-01-31", "c1", "20") for i in range(6)])
    lines = spark.createDataFrame(
        [("r0", "1", "p1", "2", "10.00"), ("r1", "1", "p1", "99999999999", "1"), ("r2", "1", "p1", "1", "1e30"),
         ("r3", "1", "p1", "2000000000", "99999"), *[("r4", str(i), "p1", "90000", "99999.99") for i in range(3)],
         ("r5", "1", "p1", "1", "12345678901")],
        "request_id string, line_no string, product_id string, quantity string, unit_price string")
    made = documents.create_invoices(t, heads, lines, NOW)
    assert reasons(made) == {f"r{i}": "out_of_range" for i in range(1, 6)}
    assert rows(made.rows["invoices"], "number", "total") == [("N0", Decimal("24.00"))]
    carried = documents.create_deliveries(
        t, heads.drop("vat_rate"), lines.drop("unit_price").withColumn("unit", F.lit("kg")), NOW)
    assert reasons(carried) == {"r1": "out_of_range"}


@pytest.mark.parametrize("field, value", [("price", "1e30"), ("price", "12345678901"), ("weight", "1000000")])
def test_products_out_of_range(spark, t, field, value):
    given = {"code": "NEW", "name": "n", "price": "1", "weight": "1", field: value}
    asked = spark.createDataFrame([("r1", *given.values())], "request_id string, " + ", ".join(f"{c} string" for c in given))
    assert reasons(registers.create_products(t, asked, NOW)) == {"r1": "out_of_range"}


def test_group_quantities_out_of_range(spark, t):
    asked = requests(spark, "id string, original_quantity string", ("r1", "g1", "1e30"), ("r2", "g1", "5"))
    made = registers.patch_groups(t, asked, NOW)
    assert reasons(made) == {"r1": "out_of_range"}


def test_client_terms_out_of_range(spark, t):
    fields = {"name": "n", "legal_name": "l", "mb": "MB", "pib": "PIB", "address": "a", "installment_term": "3000000000"}
    asked = spark.createDataFrame([("r1", *fields.values())], "request_id string, " + ", ".join(f"{c} string" for c in fields))
    assert reasons(registers.create_clients(t, asked, NOW)) == {"r1": "out_of_range"}


def test_log_ids_differ(spark, billed):
    asked = requests(spark, "id string, status string", ("r1", "v1", "confirmed"), ("r2", "v3", "confirmed"))
    made = documents.set_invoice_status(billed, asked, NOW)
    log = changes.append_activity(frame(spark, "activity_logs", []), made.activity)
    assert log.count() == 4 and log.select("id").distinct().count() == 4
    assert all('"timestamp":' in r["details"] for r in log.collect())


def test_several_parts_are_several_log_rows(spark, billed):
    moves = spark.createDataFrame([("r1", "v1", dt.date(2024, 1, 1))], "request_id string, invoice_id string, date date")
    lines = frame(spark, "invoice_items", [
        {"id": f"v1-{n}", "invoice_id": "v1", "product_id": "p1", "quantity": 1} for n in range(5)])
    walk = stock.stock_walk(moves, lines, billed["products"], billed["product_group_items"], billed["product_groups"])
    parts = stock.stock_update_log(walk, NOW, chunk=2).collect()
    assert sorted(r["part"] for r in parts) == [1, 2, 3] and len({r["details"] for r in parts}) == 3
    assert sum(r["update_count"] for r in parts) == 5


def test_requests_take_stock_in_their_order(spark, billed):
    moves = spark.createDataFrame(
        [("r1", "v3", dt.date(2024, 1, 3)), ("r2", "v1", dt.date(2023, 1, 1))], "request_id string, invoice_id string, date date")
    walk = stock.stock_walk(moves, billed["invoice_items"], billed["products"], billed["product_group_items"], billed["product_groups"])
    first = {r["request_id"]: r["old_stock"] for r in walk.collect()}
    assert first["r1"] > first["r2"]
