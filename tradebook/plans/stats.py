"""Statistics for all clients, products and users at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import period_start
from tradebook.operators.joins import client_product_lines, client_usage, line_usage
from tradebook.operators.search import between_dates, top_k, where_all

Tables = Mapping[str, DataFrame]


def _confirmed_since(t: Tables, period: str, as_of: dt.date | None) -> DataFrame:
    invoices = t["invoices"].filter(F.col("status") == "confirmed")
    return invoices.filter(F.col("date") >= period_start(period, as_of))


def _best(sold: DataFrame, quantity: str) -> DataFrame:
    """The product with the largest quantity per client, the lowest id on a tie.

    ``min`` over (negated quantity, id) is combined before the shuffle, unlike a ranking window.
    """
    rank = F.struct((-F.col(quantity)).alias("q"), F.col("product_id").alias("id"))
    return sold.filter(F.col(quantity).isNotNull()).groupBy("client_id").agg(F.min(rank).alias("_top"))


def top_product_per_client(t: Tables, period: str = "year", as_of: dt.date | None = None) -> DataFrame:
    lines = client_product_lines(t["invoice_items"], _confirmed_since(t, period, as_of))
    sold = lines.groupBy("client_id", "product_id").agg(F.sum("quantity").alias("_q"))
    best = _best(sold, "_q").select(
        "client_id", F.col("_top.id").alias("product_id"), (-F.col("_top.q")).alias("quantity"))
    names = t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return best.join(names, "product_id").select("client_id", "product_id", "product_name", "quantity")


def annual_consumption(t: Tables, as_of: dt.date | None = None) -> DataFrame:
    """Quantity per client over the year holding ``as_of``, whatever period is shown elsewhere."""
    lines = client_product_lines(t["invoice_items"], _confirmed_since(t, "year", as_of))
    return lines.groupBy("client_id").agg(F.sum("quantity").alias("annual_consumption"))


def client_statistics(t: Tables, period: str = "year", as_of: dt.date | None = None) -> DataFrame:
    """Per client: confirmed invoices of the period, their average and sum, the most sold product,
    and the year's consumption. Clients without invoices get 0, 0, 0, NULL, 0.

    The year covers the period, so invoice lines are read and joined once for both.
    """
    year = _confirmed_since(t, "year", as_of)
    in_period = F.col("date") >= period_start(period, as_of)
    total = F.sum("total")
    money = year.filter(in_period).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.round(total / F.count(F.lit(1)), 2).cast("decimal(16,2)").alias("average_order_value"),
        total.cast("decimal(22,2)").alias("total_revenue"),
    )
    lines = client_product_lines(t["invoice_items"], year, [in_period.alias("_in")])
    sold = lines.groupBy("client_id", "product_id").agg(
        F.sum("quantity").alias("_year"), F.sum(F.when(F.col("_in"), F.col("quantity"))).alias("_q"))
    rank = F.struct((-F.col("_q")).alias("q"), F.col("product_id").alias("id"))
    per_client = sold.groupBy("client_id").agg(
        F.sum("_year").alias("annual_consumption"),
        F.min(F.when(F.col("_q").isNotNull(), rank)).alias("_top"))
    names = t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("most_popular_product"))
    taste = per_client.select("client_id", "annual_consumption", F.col("_top.id").alias("product_id"))
    taste = taste.join(names, "product_id", "left")
    zero = F.lit(0)
    return (
        t["clients"].select(F.col("id").alias("client_id"))
        .join(money, "client_id", "left").join(taste, "client_id", "left")
        .select(
            "client_id",
            F.coalesce("invoice_count", zero).alias("invoice_count"),
            F.coalesce("average_order_value", zero.cast("decimal(16,2)")).alias("average_order_value"),
            F.coalesce("total_revenue", zero.cast("decimal(22,2)")).alias("total_revenue"),
            "most_popular_product",
            F.coalesce("annual_consumption", zero).alias("annual_consumption"),
            F.lit(period).alias("period"),
        )
    )


def _sold(t: Tables) -> DataFrame:
    return t["invoice_items"].groupBy(F.col("product_id").alias("id")).agg(
        F.count_distinct("invoice_id").alias("invoice_count"),
        F.sum("quantity").alias("total_sold_quantity"),
        F.sum("total_price").alias("total_revenue"),
    )


def _delivered(t: Tables) -> DataFrame:
    return t["delivery_items"].groupBy(F.col("product_id").alias("id")).agg(
        F.count_distinct("delivery_id").alias("delivery_count"),
        F.count(F.lit(1)).alias("_lines"),
    )


def _product_stats(t: Tables, factor) -> DataFrame:
    zero = F.lit(0)
    return (
        t["products"].select("id", "code", "name")
        .join(_sold(t), "id", "left").join(_delivered(t), "id", "left")
        .select(
            "id", "code", "name",
            F.coalesce("invoice_count", zero).alias("invoice_count"),
            F.coalesce("delivery_count", zero).alias("delivery_count"),
            (F.coalesce("total_sold_quantity", zero) * factor).cast("long").alias("total_sold_quantity"),
            (F.coalesce("total_revenue", zero.cast("decimal(22,2)")) * factor)
            .cast("decimal(28,2)").alias("total_revenue"),
        )
    )


def product_stats(t: Tables) -> DataFrame:
    """Per product: invoices, deliveries, sold quantity and revenue over all statuses."""
    return _product_stats(t, F.lit(1))


def product_stats_fanout(t: Tables) -> DataFrame:
    """The figures a double join of both line tables gives: sums repeat once per delivery line.

    Computed as sum times number of delivery lines, so no pair of lines is ever formed.
    """
    return _product_stats(t, F.greatest(F.lit(1), F.coalesce("_lines", F.lit(0))))


def stats_logs(
    t: Tables, start: dt.datetime | None = None, end: dt.datetime | None = None,
    user_id: object | None = None,
) -> DataFrame:
    """The log rows the three activity reports share; cache it when running all three."""
    return where_all(between_dates(t["activity_logs"], "created_at", start, end), user_id=user_id)


def activity_overview(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("entity_type").alias("entity_types"),
        F.count_distinct(F.to_date("created_at")).alias("active_days"),
    )


def actions_by_type(logs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent entity types; NULL is one of them."""
    counts = logs.groupBy("entity_type").agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, "count", ["entity_type"], k)


def actions_by_user(logs: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """The busiest users. The system group takes a place among the ``k`` and is dropped after.

    Counting happens before the user join, which then sees one row per user.
    """
    counts = logs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    who = users.select(F.col("id").alias("user_id"), F.col("id"), "username", "full_name")
    merged = counts.join(who, "user_id", "left").groupBy("id", "username", "full_name").agg(
        F.sum("_n").alias("count"))
    return top_k(merged, "count", ["id"], k).filter(
        F.col("username").isNotNull() & (F.col("username") != "")
    ).select("username", "full_name", "count")


def client_dependencies(t: Tables) -> DataFrame:
    return client_usage(t["clients"].select("id"), t["invoices"], t["deliveries"])


def product_usage(t: Tables) -> DataFrame:
    return line_usage(t["products"].select("id"), t["invoice_items"], t["delivery_items"])
