"""The activity log as a stream: deduplicated sink, daily counts, request rates.

Nothing depends on a watermark. A micro-batch adds the partial counts of its own rows, per window and key, to ``runs`` of such
counts; readers add them up. So late rows count however old they are, every window is there when the stream
stops, no day is counted again, and a batch that is run again changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructType

from tradebook.streaming.runs import carried, drop_merged, newest, read_runs, write_run


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def activity_windows(
    df: DataFrame, window: str = "1 day", keys: Sequence[str] = ("entity_type", "user_id")
) -> DataFrame:
    """Counts of distinct log rows per window and key."""
    counts = df.dropDuplicates(["id"]).groupBy(F.window("created_at", window), *keys).agg(
        F.count(F.lit(1)).alias("actions"))
    return _flat(counts, keys, "actions")


def request_rate(
    df: DataFrame, key: str = "ip_address", window: str = "15 minutes", limit: int = 100
) -> DataFrame:
    """Keys with more than ``limit`` requests in a fixed window."""
    counts = df.groupBy(F.window("created_at", window), key).agg(F.count(F.lit(1)).alias("requests"))
    return _flat(counts.filter(F.col("requests") > limit), [key], "requests")


def _flat(counts: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    return counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys, measure)


def _of_days(days: Sequence[dt.date | None]) -> Column:
    known = F.col("day").isin([d for d in days if d is not None])
    return known | F.col("day").isNull() if None in days else known


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows of a stream with the columns ``schema``, plus their day and batch."""
    full = StructType([*schema.fields]).add("day", DateType()).add("batch", LongType())
    return spark.read.schema(full).parquet(path)


def _store(rows: DataFrame, version: int, path: str) -> None:
    """Replace only the partitions that ``rows`` has."""
    rows.withColumn("batch", F.lit(version).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def new_rows(batch: DataFrame, version: int, path: str) -> DataFrame:
    """Rows of a micro-batch, each id once, that no earlier batch stored under ``path``, with their day.

    Equal ids have equal times, so of the stored rows only the ids of the batch's own days are read.
    """
    rows = batch.withColumn("day", F.to_date("created_at")).dropDuplicates(["id"])
    if version == 0:
        return rows
    days = [r["day"] for r in rows.select("day").distinct().collect()]
    before = stored(batch.sparkSession, path, batch.schema).filter(_of_days(days) & (F.col("batch") < version))
    return rows.join(before.select("id"), "id", "left_anti").select(*rows.columns)


def store_batch(batch: DataFrame, version: int, path: str) -> None:
    """Store the new rows of a micro-batch under ``path``, a folder per day and batch.

    A batch replaces what an earlier try of itself wrote.
    """
    _store(new_rows(batch, version, path), version, path)


def merged_counts(counts: DataFrame, version: int, out: str) -> DataFrame:
    """The counts of micro-batch ``version`` added to those of the runs that its own run takes in.

    Counts have windows and keys first and the number last. Nothing else is read, neither log rows nor other runs.
    """
    *group, measure = counts.columns
    below = read_runs(counts.sparkSession, out, carried(version), counts.schema)
    return counts.unionByName(below).groupBy(*group).agg(F.sum(measure).alias(measure))


def add_counts(counts: DataFrame, version: int, out: str) -> None:
    """Write the run of ``version`` under ``out``, sorted by window."""
    drop_merged(counts.sparkSession, out, version)
    write_run(merged_counts(counts, version, out), out, version, *counts.columns[:-1])


def kept_counts(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The counts that a stream holds under ``out``: its runs added up; ``schema`` is that of the batch form.

    Runs are sorted by ``window_start``, so a filter on it after this skips files and row groups.
    """
    *group, measure = schema.names
    return read_runs(spark, out, newest(spark, out), schema).groupBy(*group).agg(F.sum(measure).alias(measure))


def _each_batch(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what is there, batch by batch, and stop."""
    return (
        df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def activity_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the log to ``path`` by day, each id once, however late it comes."""
    def work(batch: DataFrame, version: int) -> None:
        store_batch(batch, version, path)

    return _each_batch(df, checkpoint, work)


def windows_stream(
    df: DataFrame, path: str, out: str, checkpoint: str, window: str = "1 day",
    keys: Sequence[str] = ("entity_type", "user_id"),
) -> StreamingQuery:
    """Keep ``activity_windows`` under ``out``, to be read by ``kept_counts``; the log itself is stored under ``path``."""
    def work(batch: DataFrame, version: int) -> None:
        rows = new_rows(batch, version, path).persist()
        try:
            add_counts(activity_windows(rows, window, keys), version, out)
            _store(rows, version, path)
        finally:
            rows.unpersist()

    return _each_batch(df, checkpoint, work)


def rate_stream(
    df: DataFrame, out: str, checkpoint: str, key: str = "ip_address", window: str = "15 minutes"
) -> StreamingQuery:
    """Keep the number of requests per window and key under ``out``, to be read by ``kept_counts`` and cut by its limit.

    Every row counts, repeated ones too, so no log is stored.
    """
    def work(batch: DataFrame, version: int) -> None:
        add_counts(request_rate(batch, key, window, limit=0), version, out)

    return _each_batch(df, checkpoint, work)
