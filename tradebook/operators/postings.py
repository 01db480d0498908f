"""Contains-search through postings of trigrams.

A posting (slot, gram, field, key) says that a column of a row holds three characters next to each other, in lower case.
Postings are stored by slot, a hash of the gram, and sorted by gram, so a search reads only the folders of a few grams of its
term. They name a superset of the rows; the search itself verifies these. Terms without three characters between wildcards
are searched by a scan.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

GRAM = 3
SLOTS = 64
#: Grams that a search reads, the rarest of its term.
PROBES = 3
#: Keys that may be named one by one in a filter on the table, so that its files and buckets are pruned by them.
FEW = 1_000
#: Postings that one task makes and writes.
PER_TASK = 1 << 20


@dataclass(frozen=True)
class Postings:
    """``rows``: slot, gram, field, key; ``counts``: slot, gram, field, n; ``fields``: the columns that have postings."""

    rows: DataFrame
    counts: DataFrame
    fields: frozenset[str]


def _grams(name: str) -> Column:
    text = F.lower(F.col(name).cast("string"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM)))
    known = F.when(F.length(text) >= GRAM, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.lit(name).alias("field"), known.alias("grams"))


def postings(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """The postings of ``columns``, in one scan. A NULL or a shorter text has none."""
    fields = df.select(F.col(key).alias("key"), F.inline(F.array(*[_grams(c) for c in columns])))
    every = fields.select("key", "field", F.explode("grams").alias("gram"))
    return every.select(F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).cast("int").alias("slot"), "gram", "field", "key")


def store_postings(df: DataFrame, columns: Sequence[str], path: str, key: str = "id", append: bool = False) -> None:
    """Store the postings under ``path``, or with ``append`` add those of new or changed rows.

    A short row makes many postings, so the rows are dealt out by the number of postings and not by the length of the files.
    A slot is cut by hashes of the key, so a gram that most rows have is spread over several files. What an append that is run
    again stores twice does not alter a search, and neither does a posting of a row that is gone or says something else now.
    Searches may use the postings once this has returned; one that broke off has to be run again.
    """
    mode = "append" if append else "overwrite"
    slim = df.select(*dict.fromkeys([key, *columns]))
    most = slim.agg(F.sum(functools.reduce(operator.add, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns])))
    tasks = -(-(most.first()[0] or 1) // PER_TASK)
    cuts = -(-tasks // 8)
    made = postings(slim.repartition(tasks), columns, key)
    made.repartition(max(tasks, SLOTS // 8), "slot", F.pmod(F.xxhash64("key"), F.lit(cuts))).sortWithinPartitions(
        "slot", "gram").write.mode(mode).partitionBy("slot").parquet(f"{path}/rows")
    # What was stored is read back by runs of equal grams; an append counts its own rows only.
    stored = made if append else df.sparkSession.read.schema("gram string, field string, slot int").parquet(f"{path}/rows")
    counts = stored.groupBy("slot", "gram", "field").agg(F.count(F.lit(1)).alias("n"))
    counts.sort("gram", "field").write.mode(mode).parquet(f"{path}/counts")
    named = StructType([StructField("field", StringType()), StructField("key", df.schema[key].dataType)])
    df.sparkSession.createDataFrame([(c, None) for c in columns], named).coalesce(1).write.mode(mode).parquet(f"{path}/fields")


def open_postings(spark: SparkSession, path: str) -> Postings:
    named = spark.read.parquet(f"{path}/fields")  # a row for each column
    rows = StructType([StructField("gram", StringType()), *named.schema.fields, StructField("slot", IntegerType())])
    counts = spark.read.parquet(f"{path}/counts")
    return Postings(spark.read.schema(rows).parquet(f"{path}/rows"), counts, frozenset(r["field"] for r in named.collect()))


def stretches(pattern: str) -> Iterator[str]:
    """The literal texts between the wildcards of a LIKE pattern."""
    text, characters = "", iter(pattern)
    for c in characters:
        if c in "%_":
            yield text
            text = ""
        else:
            text += next(characters, "") if c == "\\" else c
    yield text


def grams_of(spark: SparkSession, pattern: str) -> list[str]:
    """The grams that a text must have to meet a LIKE pattern; lower case as the engine makes it."""
    lowered = spark.sql("SELECT lower(:pattern)", args={"pattern": pattern}).first()[0]
    return sorted({text[i:i + GRAM] for text in stretches(lowered) for i in range(len(text) - GRAM + 1)})


def candidates(index: Postings, fields: Sequence[Column | str], pattern: str) -> tuple[DataFrame, int] | None:
    """Keys of a superset of the rows with a field that meets ``pattern``, and a bound of their number.

    None when the pattern has no gram, or a field no postings. A gram that no field has leaves no key.
    """
    spark = index.rows.sparkSession
    if not all(isinstance(f, str) and f in index.fields for f in fields):
        return None
    grams = grams_of(spark, pattern)
    if not grams:
        return None
    of_fields = F.col("field").isin(list(fields))
    known = index.counts.filter(F.col("gram").isin(grams) & of_fields).groupBy("slot", "gram").agg(F.sum("n").alias("n")).collect()
    if len(known) < len(grams):
        return index.rows.select("key").limit(0), 0
    rare = sorted(known, key=lambda r: (r["n"], r["gram"]))[:PROBES]
    bits = functools.reduce(operator.add, [F.when(F.col("gram") == r["gram"], 1 << i).otherwise(0) for i, r in enumerate(rare)])
    near = index.rows.filter(
        F.col("slot").isin(sorted({r["slot"] for r in rare})) & F.col("gram").isin([r["gram"] for r in rare]) & of_fields)
    held = near.groupBy("field", "key").agg(F.bit_or(bits).alias("held")).filter(F.col("held") == (1 << len(rare)) - 1)
    return held.select("key").distinct(), rare[0]["n"]


def among(df: DataFrame, found: DataFrame, most: int, key: str = "id") -> DataFrame:
    """Rows whose key is in ``found``. At most FEW keys, by their bound, are named in the filter; more are joined."""
    if most <= FEW:
        return df.filter(F.col(key).isin([r[0] for r in found.collect()]))
    return df.join(found.withColumnRenamed("key", key), key, "left_semi")
