"""Dated full copies of tables and their retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_tables(tables: Mapping[str, DataFrame], path: str, ts: dt.datetime) -> str:
    """Write every table under ``path/ts=…/<table>`` and return that folder."""
    folder = f"{path}/ts={ts:%Y%m%d_%H%M%S}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def expired_snapshots(manifest: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """Flag each snapshot of ``manifest(snapshot, taken_at)`` whose age in whole days exceeds ``days``.

    ``remaining`` repeats the number of snapshots that stay.
    """
    limit = F.lit(now - dt.timedelta(days=days + 1))
    flagged = manifest.select("snapshot", "taken_at", (F.col("taken_at") <= limit).alias("expired"))
    kept = flagged.agg(F.count_if(~F.col("expired")).alias("remaining")).scalar()
    return flagged.withColumn("remaining", kept)
