"""CSV and JSON sinks for report datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, labels: Mapping[str, str] | None = None) -> None:
    """Header and rows; a value with a comma, quote or newline is quoted, inner quotes doubled.

    NULL and the empty string are both written as nothing, so both read back as NULL.
    """
    out = df if labels is None else df.select(*[F.col(f"`{c}`").alias(n) for c, n in labels.items()])
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read what ``write_csv`` wrote; values may span lines."""
    return spark.read.options(**CSV_OPTIONS, multiLine="true").schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
