"""Decisions on meaning: predicates, rounding, stock, statistics."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.small import NOW, frame, rows, seed
from tradebook.functions import expressions as x
from tradebook.operators import merge, quality, search, stock
from tradebook.plans import export, reports, stats


def names(df):
    return [r["name"] for r in df.collect()]


def test_search_wildcards_case_and_backslash(spark):
    df = spark.createDataFrame([("Alpha 10%",), ("alpHa 105",), ("beta_x",), ("betaqx",), (None,), ("back\\slash",)], "name string")
    assert len(names(search.search_any(df, ["name"], "ALPHA"))) == 2
    assert len(names(search.search_any(df, ["name"], "a_x"))) == 2
    assert names(search.search_any(df, ["name"], "a\\_x")) == ["beta_x"]
    assert names(search.search_any(df, ["name"], "10\\%")) == ["Alpha 10%"]
    assert names(search.search_any(df, ["name"], "b\\eta_")) == ["beta_x", "betaqx"]
    assert names(search.search_any(df, ["name"], "\\\\sl")) == ["back\\slash"]
    assert search.search_any(df, ["name"], "").count() == 6


def test_page_arguments_and_envelope(spark):
    df = spark.range(101)
    with pytest.raises(ValueError):
        search.page_of(df, [search.Sort(F.col("id"))], 0)
    with pytest.raises(ValueError):
        search.page_of(df, [search.Sort(F.col("id"))], 1, 101)
    assert rows(search.page_info(df, 3, 50)) == [(3, 50, 101, 3, False, True)]
    assert rows(search.page_info(df.filter("id < 0"), 1, 50)) == [(1, 50, 0, 0, False, False)]


def test_pages_put_together_are_the_whole_list(spark):
    t = seed(spark)
    t["clients"] = frame(spark, "clients", [
        {"id": f"c{i}", "name": f"N{i % 7}", "legal_name": "L", "mb": str(i), "pib": str(i), "address": "A"} for i in range(53)])
    pages = [r["id"] for p in range(1, 7) for r in reports.list_clients(t, page=p, limit=10).collect()]
    whole = [r["id"] for r in reports.clients_found(t).orderBy("name", "id").collect()]
    assert pages == whole and len(pages) == 53


def test_names_follow_bytes_unless_a_collation_is_given(spark):
    t = seed(spark)
    t["clients"] = frame(spark, "clients", [{"id": n, "name": n, "mb": n, "pib": n} for n in ("b", "A", "č", "C")])
    assert names(reports.list_clients(t)) == ["A", "C", "b", "č"]
    assert names(reports.list_clients(t, collation="UNICODE")) == ["A", "b", "C", "č"]


def test_unknown_period_means_year(spark):
    df = spark.createDataFrame([(dt.date(2001, 1, 1),), (dt.date(2000, 12, 31),), (dt.date(2099, 1, 1),)], "d date")
    assert search.in_period(df, "d", "decade", dt.date(2001, 5, 20)).count() == 2


def test_newest_first_puts_null_times_on_top(spark):
    df = spark.createDataFrame([(1, NOW), (2, None), (3, NOW - dt.timedelta(1))], "id int, created_at timestamp_ntz")
    assert [r["id"] for r in search.sorted_by(df, search.newest_first()).collect()] == [2, 1, 3]


def test_flags_without_value_read_no(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [tuple(r) for r in df.select(x.yes_no("f"), x.active_label("f")).collect()] == [
        ("Yes", "Active"), ("No", "Inactive"), ("No", "Inactive")]


def test_permissions(spark):
    users = frame(spark, "users", [
        {"id": "1", "username": "a", "role": "admin", "is_active": True, "permissions": None},
        {"id": "2", "username": "b", "role": "user", "is_active": True, "permissions": '{"clients":true,"products":false}'},
        {"id": "3", "username": "c", "role": "admin", "is_active": False, "permissions": "{}"},
        {"id": "4", "username": "d", "role": "user", "is_active": True, "permissions": None}])
    assert rows(search.granted(users, "clients"), "id") == [("1",), ("2",)]
    assert rows(search.granted(users, "products"), "id") == [("1",)]
    assert search.granted_all(users).count() == 8


def test_money_is_rounded_half_up_and_independently(spark):
    df = spark.createDataFrame([(Decimal("0.03"), Decimal("17.50"))], "s decimal(12,2), r decimal(5,2)")
    assert rows(df.select(x.vat_of("s", "r"), x.total_with_vat("s", "r"))) == [(Decimal("0.01"), Decimal("0.04"))]
    df = spark.createDataFrame([(Decimal("2.30"), Decimal("2.50"))], "s decimal(12,2), r decimal(5,2)")
    assert rows(df.select(x.vat_of("s", "r"), x.total_with_vat("s", "r"))) == [(Decimal("0.06"), Decimal("2.36"))]


def test_initial_stock(spark):
    df = spark.createDataFrame([(Decimal(10000), Decimal(500)), (Decimal(100), Decimal(99)), (Decimal("0.01"), None)],
                               "o decimal(12,2), r decimal(12,2)")
    assert [r[0] for r in df.select(x.initial_stock("o", "r")).collect()] == [Decimal("9000.00"), Decimal("0.00"), Decimal("0.01")]


@pytest.mark.parametrize(("text", "email"), [
    ("Some.One+tag@Gmail.com", "someone@gmail.com"), ("A.B@GoogleMail.com", "ab@gmail.com"),
    ("Me+x@Outlook.com", "me@outlook.com"), ("me-x@yahoo.com", "me@yahoo.com"), (" U.V+w@Example.COM ", "u.v+w@example.com"),
    ("a+x@me.example.com", "a+x@me.example.com"), ("a+y@live.example.org", "a+y@live.example.org"), ("w+t@ya.ru", "w+t@yandex.ru")])
def test_normalized_email(spark, text, email):
    assert rows(spark.createDataFrame([(text,)], "e string").select(x.normalized_email("e"))) == [(email,)]


def test_text_forms(spark):
    def check(column, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "v string")
        return [r[0] for r in df.select(F.coalesce(column, F.lit(False))).collect()]

    assert check(x.is_email("v"), "a@b.co", "a@b", "a b@c.co", "a..b@c.co", None) == [True, False, False, False, False]
    assert check(x.is_url("v"), "http://a.co/x?y", "a.co", "htp:/bad", "https://a") == [True, True, False, False]
    assert check(x.is_date("v"), "2024-02-29", "2023-02-29", "2024-01-01T10:00:00Z", "01.02.2024") == [True, False, True, False]
    assert check(x.is_integer("v", 1), "1", "0", "1.5", "+7", "99999999999999999999") == [True, False, False, True, True]
    assert check(x.is_number("v", 0, 100), "1e1", "-1", "100.01", ".5", "abc", "") == [True, False, False, True, False, False]


def test_seed_walk(spark):
    t = seed(spark)
    items = frame(spark, "invoice_items", [
        {"id": "i1", "invoice_id": "v1", "product_id": "p1", "quantity": 3},
        {"id": "i2", "invoice_id": "v1", "product_id": "p2", "quantity": 20},
        {"id": "i3", "invoice_id": "v1", "product_id": "p3", "quantity": 1}])
    moves = spark.createDataFrame([("r1", "v1", dt.date(2024, 1, 2))], "request_id string, invoice_id string, date date")
    stores = (items, t["products"], t["product_group_items"], t["product_groups"])
    walk = stock.stock_walk(moves, *stores)
    assert rows(walk, "item_id", "old_stock", "new_stock") == [
        ("i1", Decimal("9000.00"), Decimal("7500.00")), ("i2", Decimal("7500.00"), Decimal("0.00"))]
    assert rows(stock.stock_balance(moves, *stores), "current_quantity") == [(Decimal("0.00"),)]
    log = stock.stock_update_log(walk, NOW).collect()
    assert len(log) == 1 and log[0]["update_count"] == 2 and '"new_stock":7500.00' in log[0]["details"]


def test_walk_equals_the_loop_on_random_data(spark):
    rng = random.Random(3)
    groups = [{"id": f"g{i}", "name": "g", "current_quantity": Decimal(rng.randrange(2000))} for i in range(4)]
    goods = [{"id": f"p{i}", "code": f"c{i}", "name": "n", "weight": Decimal(rng.choice([0, 0.5, 3, 20]))} for i in range(12)]
    bridge = [{"id": str(i), "group_id": f"g{i % 4}", "product_id": f"p{i}"} for i in range(10)]
    bridge.append({"id": "x", "group_id": "g3", "product_id": "p0"})  # a second group: the lowest counts
    heads = [(f"r{rng.randrange(100):02}-{i}", f"v{i}", dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(3))) for i in range(40)]
    items = [{"id": f"i{n:03}", "invoice_id": rng.choice(heads)[1], "product_id": rng.choice(goods)["id"], "quantity": rng.randrange(1, 9)}
             for n in range(200)]
    left = {g["id"]: g["current_quantity"] for g in groups}
    weight = {g["id"]: g["weight"] for g in goods}
    home = {}
    for b in bridge:
        home[b["product_id"]] = min(b["group_id"], home.get(b["product_id"], "z"))
    want = []
    asked = {v: r for r, v, _ in heads}
    for i in sorted(items, key=lambda i: (asked[i["invoice_id"]], i["id"])):
        group = home.get(i["product_id"])
        if weight[i["product_id"]] > 0 and group:
            old = left[group]
            left[group] = max(Decimal(0), old - weight[i["product_id"]] * i["quantity"])
            want.append((i["id"], group, old, left[group]))
    stores = (frame(spark, "invoice_items", items), frame(spark, "products", goods),
              frame(spark, "product_group_items", bridge), frame(spark, "product_groups", groups))
    moves = spark.createDataFrame(heads, "request_id string, invoice_id string, date date")
    assert rows(stock.stock_walk(moves, *stores), "item_id", "group_id", "old_stock", "new_stock") == sorted(want)
    assert dict(rows(stock.stock_balance(moves, *stores), "id", "current_quantity")) == left


def test_direct_deduction_lists_weightless_products(spark):
    t = seed(spark)
    t["products"] = t["products"].withColumn("weight", F.when(F.col("id") == "p1", F.lit(0)).otherwise(F.col("weight")).cast("decimal(8,2)"))
    lines = spark.createDataFrame([(1, "p1", 5), (2, "p2", 2)], "line_no int, product_id string, quantity int")
    got = stock.apply_stock(lines, t["products"], t["product_group_items"], t["product_groups"])
    assert rows(got, "line_no", "old_stock", "new_stock") == [
        (1, Decimal("9000.00"), Decimal("9000.00")), (2, Decimal("9000.00"), Decimal("7500.00"))]


def test_product_stats_and_its_fanout(spark):
    t = seed(spark)
    t["invoice_items"] = frame(spark, "invoice_items", [
        {"id": str(i), "invoice_id": "v", "product_id": "p1", "quantity": 2, "total_price": Decimal(10)} for i in range(3)])
    t["delivery_items"] = frame(spark, "delivery_items", [
        {"id": str(i), "delivery_id": f"d{i}", "product_id": "p1", "quantity": 1} for i in range(4)])
    assert rows(stats.product_stats(t).filter("id = 'p1'"), "invoice_count", "delivery_count", "total_sold_quantity") == [(1, 4, 6)]
    assert rows(stats.product_stats_fanout(t).filter("id = 'p1'"), "total_sold_quantity", "total_revenue") == [(24, Decimal("120.00"))]
    assert rows(stats.product_stats_fanout(t).filter("id = 'p2'"), "total_sold_quantity", "total_revenue") == [(0, Decimal("0.00"))]


def test_client_statistics(spark):
    t = seed(spark)
    day = dt.date(2001, 5, 1)
    t["invoices"] = frame(spark, "invoices", [
        {"id": "a", "client_id": "c1", "status": "confirmed", "date": day, "total": Decimal("10.01")},
        {"id": "b", "client_id": "c1", "status": "confirmed", "date": dt.date(2001, 2, 1), "total": Decimal("5")},
        {"id": "c", "client_id": "c1", "status": "draft", "date": day, "total": Decimal("99")},
        {"id": "d", "client_id": "c1", "status": "confirmed", "date": dt.date(2030, 1, 1), "total": Decimal("10")}])
    t["invoice_items"] = frame(spark, "invoice_items", [
        {"id": "1", "invoice_id": "a", "product_id": "p2", "quantity": 3}, {"id": "2", "invoice_id": "d", "product_id": "p1", "quantity": 3},
        {"id": "3", "invoice_id": "b", "product_id": "p3", "quantity": 50}])
    got = stats.client_statistics(t, "month", dt.date(2001, 5, 20)).collect()[0]
    assert (got.invoice_count, got.average_order_value, got.total_revenue) == (2, Decimal("10.01"), Decimal("20.01"))
    assert got.most_popular_product == "Sample Product 1"  # a tie goes to the lower id
    assert got.annual_consumption == 56
    t["invoices"] = t["invoices"].limit(0)
    got = stats.client_statistics(t, "year", dt.date(2001, 5, 20)).collect()[0]
    assert tuple(got) == ("c1", 0, Decimal("0.00"), Decimal("0.00"), None, 0, "year")


def test_system_rows_take_a_place_among_the_busiest(spark):
    users = frame(spark, "users", [{"id": f"u{i:02}", "username": f"n{i:02}"} for i in range(12)])
    logs = frame(spark, "activity_logs", [{"id": f"s{i}", "user_id": None, "action": "x"} for i in range(50)]
                 + [{"id": f"{u}-{i}", "user_id": f"u{u:02}", "action": "x"} for u in range(12) for i in range(3)])
    assert stats.actions_by_user(logs, users).count() == 9
    assert rows(stats.actions_by_type(logs), "entity_type", "count") == [(None, 86)]


def test_log_join_keeps_system_rows_and_export_names_them(spark):
    t = seed(spark)
    t["activity_logs"] = frame(spark, "activity_logs", [
        {"id": "1", "user_id": None, "action": "A", "created_at": NOW},
        {"id": "2", "user_id": "u1", "action": 'say "hi", all', "details": '{"k":"a,b"}', "created_at": NOW - dt.timedelta(1)}])
    got = export.export_logs(t).collect()
    assert [r["User"] for r in got] == ["System", "boss"]
    assert got[0]["Date"] == "2024-03-01T12:00:00.000Z" and got[0]["Details"] == "{}"
    assert export.export_logs(t, cap=1).count() == 1
    end_of_day = export.export_logs(t, end=dt.datetime(2024, 3, 1))
    assert end_of_day.count() == 1  # the end is midnight, so that day's rows stay out


def test_group_without_products_has_an_empty_list(spark):
    t = seed(spark)
    t["product_groups"] = t["product_groups"].unionByName(
        frame(spark, "product_groups", [{"id": "g2", "name": "Empty", "created_at": NOW}]))
    got = {r["id"]: r["products"] for r in reports.list_groups(t).collect()}
    assert got["g2"] == [] and [p["code"] for p in got["g1"]] == ["PROD001", "PROD002"]
    parts = reports.list_groups(t, chunk=1).collect()
    assert sorted((r["id"], r["part"], len(r["products"])) for r in parts) == [("g1", 1, 1), ("g1", 2, 1), ("g2", 1, 0)]
    labels = {r["Group Name"]: r["Products"] for r in export.export_product_groups(t).collect()}
    assert labels == {"Sample Group": "Sample Product 1; Sample Product 2", "Empty": ""}


def test_rule_scan(spark):
    t = seed(spark)
    bad = frame(spark, "products", [
        {"id": "1", "code": None, "name": "n", "price": Decimal(-1), "weight": None}, {"id": "2", "code": "x" * 51, "name": "n", "price": Decimal(1)}])
    got = quality.check_constraints({"products": bad})
    assert rows(got, "rule", "row_id", "value") == [
        ("code_length", "2", "x" * 51), ("code_required", "1", None), ("price_check", "1", "-1.00")]
    assert quality.check_constraints(t).count() == 0
    assert quality.check_unique(t).count() == 0 and quality.check_references(t).count() == 0


def test_null_keys_do_not_collide(spark):
    users = frame(spark, "users", [{"id": str(i), "username": f"n{i}", "email": None} for i in range(3)])
    assert quality.check_unique({"users": users}).count() == 0


def test_items_inside_requests(spark):
    c1, p1, p2 = (f"0f8fad5b-d9cb-469f-a165-7086728950{n}e" for n in "1ab")
    requests = spark.createDataFrame(
        [(1, "N1", "2024-01-01", "2024-01-02", c1, "20", [(p1, "0", "5"), (p2, "2", "x")]), (2, "N2", "2024-01-01", "bad", c1, "20", [])],
        "request_id int, number string, date string, due_date string, client_id string, vat_rate string, "
        "items array<struct<product_id: string, quantity: string, unit_price: string>>")
    got = quality.validate_invoices(requests.drop("items"), quality.unnest_items(requests))
    assert rows(got, "rule", "row_id") == [
        ("due_date_form", "2"), ("items_quantity_form", "1:1"), ("items_required", "2"), ("items_unit_price_form", "1:2")]
    odd = requests.withColumn("client_id", F.lit("c1")).filter("request_id = 1")
    got = quality.validate_invoices(odd.drop("items"), quality.unnest_items(odd))
    assert ("client_id_form", "1") in rows(got, "rule", "row_id")


def test_reconcile(spark):
    heads = frame(spark, "invoices", [
        {"id": "1", "vat_rate": Decimal(20), "subtotal": Decimal(350), "vat_amount": Decimal(70), "total": Decimal("420.01")},
        {"id": "2", "vat_rate": Decimal(20), "subtotal": Decimal(1), "vat_amount": Decimal(0), "total": Decimal(0)}])
    items = frame(spark, "invoice_items", [
        {"id": "a", "invoice_id": "1", "quantity": 2, "unit_price": Decimal(100), "total_price": Decimal(200)},
        {"id": "b", "invoice_id": "1", "quantity": 1, "unit_price": Decimal(150), "total_price": Decimal(150)},
        {"id": "c", "invoice_id": "9", "quantity": 1, "unit_price": Decimal(150), "total_price": Decimal(151)}])
    assert rows(quality.reconcile_invoices(heads, items), "rule", "row_id", "value") == [("line_total", "c", "1.00"), ("subtotal", "2", "1.00")]


def test_upsert_and_insert_ignore(spark):
    base = spark.createDataFrame([("boss", "old", "f1"), ("other", "x", "f2")], "username string, role string, full_name string")
    new = spark.createDataFrame([(1, "boss", "admin", "f9"), (2, "fresh", "user", "f3"), (3, "fresh", "user", "f4")],
                                "request_id int, username string, role string, full_name string")
    assert rows(merge.upsert(base, new, ["username"], ["role"], order="request_id")) == [
        ("boss", "admin", "f1"), ("fresh", "user", "f4"), ("other", "x", "f2")]
    assert rows(merge.insert_ignore(base, new, ["username"], "request_id")) == [
        ("boss", "old", "f1"), ("fresh", "user", "f3"), ("other", "x", "f2")]


def test_first_come_equals_the_loop(spark):
    rng = random.Random(11)
    for _ in range(3):
        data = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"uvwxyz12"])) for i in range(60)]
        seen_a, seen_b, want = set(), set(), []
        for i, a, b in data:
            if a in seen_a or b in seen_b:
                continue
            want.append(i)
            seen_a |= {a} - {None}
            seen_b |= {b} - {None}
        df = spark.createDataFrame(data, "request_id int, a string, b string")
        assert sorted(r[0] for r in merge.first_come(df, ["a", "b"]).collect()) == want


def test_log_details_can_be_parsed(spark):
    t = seed(spark)
    t["activity_logs"] = frame(spark, "activity_logs", [
        {"id": "1", "user_id": "u1", "action": "A", "details": '{"k":{"n":7}}', "created_at": NOW},
        {"id": "2", "user_id": "u1", "action": "B", "details": "not json", "created_at": NOW}])
    got = reports.list_logs(t, parsed=True).select("id", F.try_variant_get("details", "$.k.n", "int").alias("n"))
    assert rows(got) == [("1", 7), ("2", None)]


def test_viewers_see_what_the_rule_lets_them(spark):
    users = frame(spark, "users", [{"id": "a", "username": "a", "role": "admin"}, {"id": "b", "username": "b", "role": "user"},
                                   {"id": "c", "username": "c", "role": "user"}])
    logs = frame(spark, "activity_logs", [{"id": str(i), "user_id": u, "action": "x"} for i, u in enumerate(["a", "b", "b", None])])
    assert rows(search.visible_log_counts(logs, users), "id", "visible") == [("a", 4), ("b", 2), ("c", 0)]
    for viewer, role, seen in (("a", "admin", 4), ("b", "user", 2), ("c", "user", 0)):
        assert search.visible_logs(logs, viewer, role).count() == seen
    assert search.visible_logs(logs, "a", "admin", "b").count() == 2
    assert search.visible_logs(logs, "c", "user", "b").count() == 0


def test_pages_count_lines_of_documents_with_and_without_lines(spark):
    t = seed(spark)
    t["invoices"] = frame(spark, "invoices", [
        {"id": f"v{i}", "number": f"N{i}", "client_id": "c1", "status": "draft", "date": dt.date(2024, 1, 1), "created_at": NOW} for i in range(5)])
    t["invoice_items"] = frame(spark, "invoice_items", [{"id": str(i), "invoice_id": "v1", "product_id": "p1", "quantity": 1} for i in range(3)])
    assert [(r["id"], r["item_count"]) for r in reports.list_invoices(t, page=1, limit=2).collect()] == [("v0", 0), ("v1", 3)]
    assert [r["id"] for r in reports.list_invoices(t, search="sample", page=3, limit=2).collect()] == ["v4"]
    assert reports.list_invoices(t, client_id="zz").count() == 0
