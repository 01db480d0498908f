"""Storing tables so that later joins and filters touch less.

Documents and their lines are bucketed alike on the document id: joining or counting lines per
document then needs no shuffle. The log is kept in order of time, so file statistics let a date
filter skip row groups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The key each table is bucketed and sorted on.
BUCKET_KEYS = {
    "invoices": "id", "invoice_items": "invoice_id", "deliveries": "id", "delivery_items": "delivery_id",
    "clients": "id", "products": "id", "users": "id", "product_groups": "id",
    "product_group_items": "product_id",
}


def store_bucketed(
    tables: Mapping[str, DataFrame], database: str, buckets: int, path: str | None = None
) -> None:
    """Save tables in a catalog database with the same number of buckets each.

    Rows are shuffled on the key first, so every bucket is one file instead of one per task. Every key
    is an id; lines of one document share a bucket, so use plain files where single documents are
    huge.
    """
    for name, df in tables.items():
        target = f"{database}.{name}"
        if name == "activity_logs":
            writer = df.repartitionByRange(buckets, "created_at", "id").sortWithinPartitions("created_at").write
        else:
            key = BUCKET_KEYS[name]
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        if path is not None:
            writer = writer.option("path", f"{path}/{name}")
        writer.mode("overwrite").saveAsTable(target)


def open_bucketed(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database) if not t.isTemporary}
