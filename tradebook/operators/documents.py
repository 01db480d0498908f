"""Change sets of invoices and deliveries."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import MONEY, trimmed
from tradebook.operators.changes import (
    Change, Ids, Tables, compose, entries, inserted, not_in, rejections, removed, repeats, replaced,
    string_ids, without,
)
from tradebook.operators.ordered import previous
from tradebook.operators.quality import (
    breaks, delivery_line_rules, delivery_rules, invoice_line_rules, invoice_rules, unknown_keys, with_fields,
)
from tradebook.operators.stock import (
    DIRECT_ACTION, UPDATE_ACTION, balance_after, direct_updates, stock_updates, stock_walk,
)
from tradebook.session import pinned

EXACT = "decimal(24,6)"
PRICE = "decimal(10,2)"


def _known(frame: DataFrame, column: str, alias: str, mark: str) -> DataFrame:
    """The distinct values of a key column, marked for a left join."""
    return frame.select(F.col(column).alias(alias)).distinct().withColumn(mark, F.lit(True))


def _line_facts(lines: DataFrame, products: DataFrame, priced: bool) -> DataFrame:
    """What the verdict needs to know of the lines of each request, in one pass over them.

    The lines are joined with the products that are not there, few as a rule and written first, not with those that are.
    """
    rules = invoice_line_rules() if priced else delivery_line_rules()
    full = with_fields(lines, rules)
    quantity, price = F.col("quantity").try_cast("int"), F.col("unit_price").try_cast("decimal(18,6)")
    exact = (quantity * price).try_cast(EXACT) if priced else F.lit(None).cast(EXACT)
    far = quantity.isNull()
    if priced:
        far = far | F.col("unit_price").try_cast(PRICE).isNull() | F.round(exact, 2).try_cast(MONEY).isNull()
    strays = pinned(unknown_keys(lines.select("product_id"), products.select("id"))).withColumn("_unknown", F.lit(True))
    judged = full.join(strays, "product_id", "left").select(
        "request_id", breaks(rules).alias("_bad"), (F.col("product_id").isNull() | F.col("_unknown").isNotNull()).alias("_stray"),
        far.alias("_far"), exact.alias("_exact"))
    return judged.groupBy("request_id").agg(
        F.bool_or("_bad").alias("_bad"), F.bool_or("_stray").alias("_stray"), F.bool_or("_far").alias("_far"),
        F.sum("_exact").try_cast(EXACT).alias("_sum"), F.count(F.lit(1)).alias("item_count"))


def _amounts(total: Column, rate: Column) -> dict[str, Column]:
    """Subtotal, VAT and total of an exact sum, each rounded once; NULL where one does not fit."""
    vat = (total * rate / F.lit(100)).try_cast("decimal(36,12)")
    whole = F.try_add(total, vat)
    return {name: F.round(value, 2).try_cast(MONEY)
            for name, value in (("subtotal", total), ("vat_amount", vat), ("total", whole))}


def _verdict(t: Tables, table: str, requests: DataFrame, lines: DataFrame) -> DataFrame:
    """request_id, reason (NULL when accepted), exact sum and number of lines.

    Accepted are valid requests whose values fit the columns, with a new number, a known client and
    known products; of several with one number the first. Pinned, since headers, items, rejections and log all start from it.
    """
    priced = table == "invoices"
    rules = invoice_rules() if priced else delivery_rules()
    judged = (
        with_fields(requests, rules).withColumn("_head", breaks(rules))
        .join(_line_facts(lines, t["products"], priced), "request_id", "left")
        .join(_known(t[table], "number", "number", "_taken"), "number", "left")
        .join(_known(t["clients"], "id", "client_id", "_client"), "client_id", "left")
    )
    far = F.coalesce("_far", F.lit(False))
    if priced:
        rate = F.col("vat_rate").try_cast("decimal(9,6)")
        amounts = _amounts(F.col("_sum"), F.coalesce(rate, F.lit(0)))
        far = far | functools.reduce(operator.or_, [a.isNull() for a in amounts.values()])
        far = far | (F.col("vat_rate").isNotNull() & F.col("vat_rate").try_cast("decimal(5,2)").isNull())
    reason = (
        F.when(F.col("_head") | F.col("_bad") | F.col("item_count").isNull(), F.lit("invalid"))
        .when(far, F.lit("out_of_range"))
        .when(F.col("_taken"), F.lit("duplicate_number"))
        .when(F.col("_client").isNull(), F.lit("unknown_client"))
        .when(F.col("_stray"), F.lit("unknown_product"))
    )
    judged = pinned(judged.select("request_id", "number", reason.alias("reason"), "_sum", "item_count"))
    first = judged.filter(F.col("reason").isNull()).groupBy("number").agg(F.min("request_id").alias("_first"))
    late = F.col("reason").isNull() & (F.col("request_id") != F.col("_first"))
    final = F.when(late, F.lit("duplicate_number")).otherwise(F.col("reason"))
    return judged.join(first, "number", "left").select(
        "request_id", final.alias("reason"), "_sum", "item_count")


def _split(verdict: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("reason").isNull()
    return verdict.filter(ok).drop("reason"), verdict.filter(~ok).select("request_id", "reason")


def create_invoices(
    t: Tables, requests: DataFrame, lines: DataFrame, now: dt.datetime, ids: Ids = string_ids
) -> Change:
    """Headers and items from raw requests and their lines.

    Amounts are summed exactly and each is rounded once, half up.
    """
    requests = requests.withColumn("number", trimmed("number"))
    passed, rejected = _split(_verdict(t, "invoices", requests, lines))
    items = lines.join(passed.select("request_id"), "request_id", "left_semi").withColumns({
        "quantity": F.col("quantity").try_cast("int"),
        "unit_price": F.col("unit_price").try_cast("decimal(18,6)"),
    })
    exact = (F.col("quantity") * F.col("unit_price")).cast(EXACT)
    items = items.withColumns({"invoice_id": ids("invoices"), "total_price": F.round(exact, 2)})
    rate = F.col("vat_rate").try_cast("decimal(9,6)")
    heads = requests.join(passed, "request_id").withColumns({
        **_amounts(F.col("_sum"), rate),
        "date": F.substring("date", 1, 10).try_cast("date"),
        "due_date": F.substring("due_date", 1, 10).try_cast("date"),
        "vat_rate": rate,
    })
    invoices, new_heads = inserted(t["invoices"], "invoices", heads, ids, now)
    all_items, new_items = inserted(t["invoice_items"], "invoice_items", items, ids, now)
    log = entries(heads.withColumn("_id", ids("invoices")), "CREATE_INVOICE", "invoices", "_id", now,
                  [F.col(c) for c in ("number", "client_id", "total", "item_count")])
    return Change(
        {"invoices": invoices, "invoice_items": all_items}, rejected, log,
        {"invoices": new_heads, "invoice_items": new_items},
    )


def create_deliveries(
    t: Tables, requests: DataFrame, lines: DataFrame, now: dt.datetime, ids: Ids = string_ids
) -> Change:
    requests = requests.withColumn("number", trimmed("number"))
    passed, rejected = _split(_verdict(t, "deliveries", requests, lines))
    items = lines.join(passed.select("request_id"), "request_id", "left_semi").withColumns({
        "quantity": F.col("quantity").try_cast("int"),
        "unit": F.nullif(F.col("unit"), F.lit("")),
        "delivery_id": ids("deliveries"),
    })
    heads = requests.join(passed, "request_id").withColumns({
        "date": F.substring("date", 1, 10).try_cast("date"),
        "due_date": F.substring("due_date", 1, 10).try_cast("date"),
    })
    deliveries, new_heads = inserted(t["deliveries"], "deliveries", heads, ids, now)
    all_items, new_items = inserted(t["delivery_items"], "delivery_items", items, ids, now)
    log = entries(heads.withColumn("_id", ids("deliveries")), "CREATE_DELIVERY", "deliveries", "_id", now,
                  [F.col(c) for c in ("number", "client_id", "item_count")])
    return Change(
        {"deliveries": deliveries, "delivery_items": all_items}, rejected, log,
        {"deliveries": new_heads, "delivery_items": new_items},
    )


def status_steps(base: DataFrame, requests: DataFrame) -> DataFrame:
    """Each accepted request with the status it found (``old_status``) and set (``status``).

    An invoice may be confirmed and reopened many times in one batch; each request sees the one
    before it.
    """
    current = base.select("id", F.col("status").alias("_base"), "date")
    stepped = previous(requests.select("request_id", "id", "status"), ["id"], ["request_id"], "status", "_prev")
    return stepped.join(current, "id").select(
        "request_id", "id", "date", F.coalesce("_prev", "_base").alias("old_status"), "status")


def confirmations(steps: DataFrame) -> DataFrame:
    """Entries into 'confirmed', in the form the stock operators take."""
    entered = steps.filter((F.col("status") == "confirmed") & (F.col("old_status") != "confirmed"))
    return entered.select("request_id", F.col("id").alias("invoice_id"), "date")


def _set_status(t: Tables, table: str, noun: str, requests: DataFrame, now: dt.datetime):
    wrong = requests.filter(~F.coalesce(F.col("status").isin("draft", "confirmed"), F.lit(False)))
    rejected = rejections(("invalid", wrong.select("request_id")), ("not_found", not_in(requests, t[table])))
    accepted = without(requests, rejected)
    steps = status_steps(t[table], accepted)
    state, altered = replaced(t[table], table, compose(accepted, ["status"]), ["status"], now)
    action = F.concat(F.lit(f"UPDATE_{noun}_STATUS_"), F.upper("status"))
    log = entries(steps.join(accepted.drop("id", "status"), "request_id"), action, table, "id", now,
                  [F.col("old_status"), F.col("status").alias("new_status")])
    return Change({table: state}, rejected, log, {table: altered}), steps


def set_invoice_status(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """New statuses; every entry into 'confirmed' takes the invoice's weight from stock.

    Going back to draft does not give stock back, and confirming again takes it again.
    """
    change, steps = _set_status(t, "invoices", "INVOICE", requests, now)
    entered = confirmations(steps)
    stock = (t["invoice_items"], t["products"], t["product_group_items"], t["product_groups"])
    walk = stock_walk(entered, *stock)
    groups = balance_after(walk, t["product_groups"])
    moved = stock_updates(walk).join(requests.drop("id", "status"), "request_id")
    stamped = entries(moved, UPDATE_ACTION, "product_groups", None, now,
                      [F.col(c) for c in ("invoice_id", "updates", "part")])
    return replace(
        change,
        tables={**change.tables, "product_groups": groups},
        activity=change.activity.withColumn("entity_id", F.col("entity_id").cast("string"))
        .unionByName(stamped.select(*change.activity.columns)),
    )


def direct_stock_log(walk: DataFrame, now: dt.datetime, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Activity rows of direct deductions (``apply_stock`` over lines with request_id), one per request and part."""
    made = direct_updates(walk, order)
    return entries(made, DIRECT_ACTION, "product_groups", None, now, [F.col("updates"), F.col("part")])


def set_delivery_status(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    return _set_status(t, "deliveries", "DELIVERY", requests, now)[0]


def _patch(t: Tables, table: str, requests: DataFrame, columns: list[str], action: str, now: dt.datetime) -> Change:
    blank = requests.filter(F.coalesce(*columns).isNull())
    rejected = rejections(("no_fields", blank.select("request_id")), ("not_found", not_in(requests, t[table])))
    accepted = without(requests, rejected)
    state, altered = replaced(t[table], table, compose(accepted, columns), columns, now)
    log = entries(accepted, action, table, "id", now, [F.col(c) for c in columns])
    return Change({table: state}, rejected, log, {table: altered})


def set_invoice_tracking(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Sparse patch of is_delivered and is_paid."""
    return _patch(t, "invoices", requests, ["is_delivered", "is_paid"], "UPDATE_INVOICE_TRACKING", now)


def set_delivery_signed(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    return _patch(t, "deliveries", requests, ["is_signed"], "UPDATE_DELIVERY_SIGNED", now)


def _delete(t: Tables, table: str, items: str, key: str, requests: DataFrame, action: str, now: dt.datetime) -> Change:
    base = t[table].select("id", "number", "status")
    known = requests.join(base, "id")
    rejected = rejections(
        ("not_found", not_in(requests, base)),
        ("confirmed", known.filter(F.col("status") == "confirmed").select("request_id")),
        ("not_found", repeats(requests)),
    )
    accepted = without(known, rejected)
    keys = accepted.select("id")
    log = entries(accepted, action, table, "id", now, [F.col("number")])
    return Change(
        {table: removed(t[table], keys), items: removed(t[items], keys, key)}, rejected, log,
        gone={table: keys},
    )


def delete_invoices(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Drafts go, with their items."""
    return _delete(t, "invoices", "invoice_items", "invoice_id", requests, "DELETE_INVOICE", now)


def delete_deliveries(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    return _delete(t, "deliveries", "delivery_items", "delivery_id", requests, "DELETE_DELIVERY", now)
