"""Helpers the operators share: batch sizes, gapless numbering, reading rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Hand texts to Python in batches of few rows, so that a batch of long ones fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, per_task: int = 64 << 20) -> int:
    """Tasks for a shuffle of ``df``: the session's number, more when its rows would exceed ``per_task`` bytes each.

    The size is the optimizer's estimate, for files their length; an unknown one is given as a huge one.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffles(df.sparkSession), min(-(-size // per_task), 100_000) if size < 1 << 60 else 1)


def numbered(df: DataFrame, within: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """Number the rows of every key ``within`` from 0 without gaps, whatever the size of a key.

    Rows are dealt into pieces by a hash of ``order``, numbered inside each (piece, key) and moved by
    the count of the key's rows in earlier pieces. No task gets a whole key. ``df`` is read twice.
    Rows that are equal in ``order`` and ``within`` must be equal in all columns that matter.
    """
    n = spread(df)
    dealt = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(4 * n)))
    keys = ["_piece", *within]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = dealt.repartition(n, "_piece").withColumn("_own", F.row_number().over(inside))
    match = [rows[k].eqNullSafe(offsets[k]) for k in keys]
    return rows.join(offsets, match, "left").select(
        *(rows[c] for c in df.columns), (rows["_own"] - 1 + offsets["_before"]).cast("long").alias(name)
    )


def concatenated(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """All batches of a partition in one frame, also when there is none."""
    frames = list(batches)
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in columns})
