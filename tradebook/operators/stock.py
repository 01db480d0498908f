"""Warehouse stock: deductions in sequence, closing balances, assignment rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import MONEY, initial_stock, time_stamp
from tradebook.operators.joins import product_group
from tradebook.operators.ordered import nest, running_sum

WEIGHT = "decimal(20,2)"


def opening_balances(groups: DataFrame) -> DataFrame:
    """Groups with ``initial_quantity``, the opening balance their creation gives."""
    return groups.withColumn("initial_quantity", initial_stock("original_quantity", "reservation_amount"))


def stock_lines(
    lines: DataFrame, products: DataFrame, bridge: DataFrame, groups: DataFrame, guard: bool = True
) -> DataFrame:
    """Lines whose product is in a group, with the weight they take from it.

    Product and group are joined first, so the long side is joined once. ``guard`` leaves out
    products without a weight.
    """
    weighted = products.filter(F.col("weight") > 0) if guard else products
    stocked = weighted.select(
        F.col("id").alias("product_id"), F.col("code").alias("product_code"),
        F.col("name").alias("product_name"), "weight",
    ).join(product_group(bridge, groups), "product_id")
    used = (F.col("weight") * F.col("quantity")).cast(WEIGHT)
    return lines.join(stocked, "product_id").select(
        *lines.columns, "group_id", "product_code", "product_name", used.alias("weight_used")
    )


def confirmed_lines(
    transitions: DataFrame, items: DataFrame, products: DataFrame, bridge: DataFrame, groups: DataFrame
) -> DataFrame:
    """Stock lines of every entry into 'confirmed': transitions(request_id, invoice_id, date)."""
    slim = items.select("invoice_id", F.col("id").alias("item_id"), "product_id", "quantity")
    entered = transitions.select("request_id", "invoice_id", "date")
    return stock_lines(slim.join(entered, "invoice_id"), products, bridge, groups)


def _walk(lines: DataFrame, groups: DataFrame, order: Sequence[str]) -> DataFrame:
    """Old and new stock of each line when the lines of a group are taken in order.

    Deductions are never negative, so clamping at zero after each line equals clamping the running
    sum.
    """
    running = running_sum(lines, ["group_id"], order, "weight_used", "_sum")
    opening = groups.select(F.col("id").alias("group_id"), F.col("current_quantity").alias("_open"))
    zero = F.lit(0).cast("decimal(38,2)")

    def left(after: Column) -> Column:
        return F.greatest(zero, (F.col("_open") - after).cast("decimal(38,2)")).cast(MONEY)

    return (
        running.join(opening, "group_id")
        .withColumn("old_stock", left(F.col("_sum") - F.col("weight_used")))
        .withColumn("new_stock", left(F.col("_sum")))
        .drop("_sum", "_open")
    )


def stock_walk(
    transitions: DataFrame, items: DataFrame, products: DataFrame, bridge: DataFrame, groups: DataFrame
) -> DataFrame:
    """Every deduction of a batch of confirmations, by (request, item)."""
    lines = confirmed_lines(transitions, items, products, bridge, groups)
    return _walk(lines, groups, ["request_id", "item_id"])


def _closing(lines: DataFrame, groups: DataFrame) -> DataFrame:
    used = lines.groupBy(F.col("group_id").alias("id")).agg(F.sum("weight_used").alias("_used"))
    left = F.col("current_quantity") - F.coalesce(F.col("_used"), F.lit(0).cast("decimal(30,2)"))
    zero = F.lit(0).cast("decimal(38,2)")
    closing = F.greatest(zero, left.cast("decimal(38,2)")).cast(MONEY)
    return groups.join(used, "id", "left").withColumn("current_quantity", closing).drop("_used")


def stock_balance(
    transitions: DataFrame, items: DataFrame, products: DataFrame, bridge: DataFrame, groups: DataFrame
) -> DataFrame:
    """Groups with their balance after the batch: one partial-aggregated sum, no order needed."""
    return _closing(confirmed_lines(transitions, items, products, bridge, groups), groups)


def balance_after(walk: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with their balance after a walk: stock only falls, so the lowest is the last."""
    last = walk.groupBy(F.col("group_id").alias("id")).agg(F.min("new_stock").alias("_last"))
    left = F.coalesce("_last", "current_quantity")
    return groups.join(last, "id", "left").withColumn("current_quantity", left).select(*groups.columns)


def apply_stock(
    lines: DataFrame, products: DataFrame, bridge: DataFrame, groups: DataFrame,
    order: Sequence[str] = ("line_no",),
) -> DataFrame:
    """Direct deduction of given (product_id, quantity) lines, in ``order``, which must be unique.

    No status is looked at and products of weight zero are listed too.
    """
    return _walk(stock_lines(lines, products, bridge, groups, guard=False), groups, order)


def apply_stock_balance(
    lines: DataFrame, products: DataFrame, bridge: DataFrame, groups: DataFrame
) -> DataFrame:
    return _closing(stock_lines(lines, products, bridge, groups, guard=False), groups)


def _updates(walk: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: int) -> DataFrame:
    fields = [
        F.col("group_id"), F.col("product_code"), F.col("product_name"),
        F.col("quantity").alias("quantity_used"), F.col("weight_used"),
        F.col("old_stock"), F.col("new_stock"),
    ]
    return nest(walk, keys, order, fields, "updates", chunk, by=["request_id"])


def stock_updates(walk: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per confirmation with its list of updates; none when no line touched a group."""
    return _updates(walk, ["request_id", "invoice_id"], ["item_id"], chunk)


def direct_updates(walk: DataFrame, order: Sequence[str] = ("line_no",), chunk: int = 10_000) -> DataFrame:
    """One row per request of a direct deduction, whose lines must carry ``request_id``; its action
    is ``DIRECT_ACTION``."""
    return _updates(walk, ["request_id"], order, chunk)


UPDATE_ACTION = "UPDATE_STOCK_ON_INVOICE_CONFIRMATION"
DIRECT_ACTION = "UPDATE_STOCK_ON_INVOICE_APPROVAL"


def stock_update_log(walk: DataFrame, now: dt.datetime, chunk: int = 10_000) -> DataFrame:
    """The activity details of each confirmation: invoice id, its updates, their part, the time."""
    stamp = F.lit(time_stamp(now)).alias("timestamp")
    details = F.to_json(F.struct("invoice_id", "updates", "part", stamp))
    return stock_updates(walk, chunk).select(
        "request_id", "invoice_id", "part",
        F.lit(UPDATE_ACTION).alias("action"),
        F.lit("product_groups").alias("entity_type"),
        F.size("updates").cast("long").alias("update_count"), details.alias("details"),
    )


def assignable(
    requests: DataFrame, groups: DataFrame, products: DataFrame, bridge: DataFrame
) -> DataFrame:
    """Verdict on each request (request_id, group_id, product_id) to put a product into a group.

    ``reason`` is NULL when allowed. Of several allowed requests for one product the first wins.
    """
    known = groups.select(F.col("id").alias("group_id"), F.lit(True).alias("_group"))
    goods = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_product"), "weight")
    placed = bridge.select("product_id", F.lit(True).alias("_placed")).distinct()
    judged = (
        requests.join(known, "group_id", "left").join(goods, "product_id", "left")
        .join(placed, "product_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_group").isNull(), F.lit("group_not_found"))
            .when(F.col("_product").isNull(), F.lit("product_not_found"))
            .when(F.coalesce(F.col("weight"), F.lit(0)) <= 0, F.lit("no_weight"))
            .when(F.col("_placed").isNotNull(), F.lit("already_grouped")),
        )
        .select("request_id", "group_id", "product_id", "reason")
    )
    first = (
        judged.filter(F.col("reason").isNull()).groupBy("product_id")
        .agg(F.min("request_id").alias("_first"))
    )
    late = F.col("reason").isNull() & (F.col("request_id") != F.col("_first"))
    return judged.join(first, "product_id", "left").select(
        "request_id", "group_id", "product_id",
        F.when(late, F.lit("already_grouped")).otherwise(F.col("reason")).alias("reason"),
    )
