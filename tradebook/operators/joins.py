"""The joins between the ten tables.

No side is hinted: AQE measures each side and broadcasts it when it is under the session's
threshold, otherwise it shuffles and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_client(headers: DataFrame, clients: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Inner join of invoices or deliveries with client fields, given as column -> name."""
    picked = clients.select(
        F.col("id").alias("client_id"), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return headers.join(picked, "client_id")


def with_counts(headers: DataFrame, items: DataFrame, header_key: str) -> DataFrame:
    """Left join with the number of lines per header, 0 where there is none.

    Lines are counted before the join, so the join sees one row per header.
    """
    counts = items.groupBy(F.col(header_key).alias("id")).agg(F.count(F.lit(1)).alias("item_count"))
    return headers.join(counts, "id", "left").fillna(0, ["item_count"])


def with_product(items: DataFrame, products: DataFrame, columns: dict[str, str]) -> DataFrame:
    picked = products.select(
        F.col("id").alias("product_id"), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return items.join(picked, "product_id")


def group_products(groups: DataFrame, bridge: DataFrame, products: DataFrame) -> DataFrame:
    """Groups with their products, product columns NULL for an empty group."""
    members = bridge.select(F.col("group_id").alias("id"), "product_id")
    fields = products.select(
        F.col("id").alias("product_id"), F.col("code").alias("product_code"),
        F.col("name").alias("product_name"), F.col("weight").alias("product_weight"),
        F.col("price").alias("product_price"),
    )
    return groups.join(members.join(fields, "product_id", "left"), "id", "left")


def product_group(bridge: DataFrame, groups: DataFrame) -> DataFrame:
    """The one group of each product; the lowest existing group id if the data holds several."""
    known = bridge.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    return known.groupBy("product_id").agg(F.min("group_id").alias("group_id"))


def with_user(logs: DataFrame, users: DataFrame, columns: Sequence[str] = ("username", "full_name")) -> DataFrame:
    """Left join that keeps system rows.

    Rows without a user match nothing, so they don't go through the join.
    """
    right = users.select(F.col("id").alias("user_id"), *columns)
    joined = logs.filter(F.col("user_id").isNotNull()).join(right, "user_id", "left")
    kinds = {c: users.schema[c].dataType for c in columns}
    alone = logs.filter(F.col("user_id").isNull()).withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    return joined.unionByName(alone)


def logged_users(users: DataFrame, logs: DataFrame) -> DataFrame:
    """Users with at least one log row."""
    seen = logs.select(F.col("user_id").alias("id")).filter("id IS NOT NULL").distinct()
    return users.join(seen, "id", "left_semi")


def client_product_lines(
    items: DataFrame, invoices: DataFrame, extra: Sequence[Column] = ()
) -> DataFrame:
    """Invoice lines with the client of their invoice."""
    heads = invoices.select(F.col("id").alias("invoice_id"), "client_id", *extra)
    return items.select("invoice_id", "product_id", "quantity").join(heads, "invoice_id")


def line_usage(products: DataFrame, invoice_items: DataFrame, delivery_items: DataFrame) -> DataFrame:
    """Products with the number of invoice and delivery lines naming them."""
    def lines(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    return (
        products.join(lines(invoice_items, "invoice_usage"), "id", "left")
        .join(lines(delivery_items, "delivery_usage"), "id", "left")
        .fillna(0, ["invoice_usage", "delivery_usage"])
    )


def client_usage(clients: DataFrame, invoices: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Clients with their number of invoices and deliveries."""
    def heads(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("client_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    return (
        clients.join(heads(invoices, "invoice_count"), "id", "left")
        .join(heads(deliveries, "delivery_count"), "id", "left")
        .fillna(0, ["invoice_count", "delivery_count"])
    )
