"""Stock kept up to date as status requests arrive.

What earlier micro-batches did is kept in a ledger: the requests that were applied, and the last status of every invoice
they named. The ledger is a set of ``runs`` sorted by key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradebook.operators.changes import compose
from tradebook.operators.documents import confirmations, status_steps
from tradebook.operators.stock import stock_balance
from tradebook.streaming.runs import Run, carried, drop_merged, read_runs, runs, write_run

Tables = Mapping[str, DataFrame]

LEDGER = "kind string, key string, status string, version bigint"


def balances(spark: SparkSession, state: str, version: int) -> DataFrame:
    """The groups as they stood after micro-batch ``version``."""
    return spark.read.parquet(f"{state}/balance/version={version}")


def read_ledger(spark: SparkSession, state: str, some: list[Run]) -> DataFrame:
    return read_runs(spark, f"{state}/ledger", some, LEDGER)


def _between(column: str, low: object, high: object) -> Column:
    """Lets files and row groups outside the range be skipped; a batch without rows names nothing."""
    return F.lit(False) if low is None else F.col(column).between(F.lit(low), F.lit(high))


def _named(spark: SparkSession, state: str, version: int, kind: str, keys: DataFrame) -> DataFrame:
    """The newest ledger row (key, status) of each of ``keys`` before ``version``."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    rows = read_ledger(spark, state, runs(version)).filter((F.col("kind") == kind) & _between("key", low, high))
    return rows.join(keys, "key", "left_semi").groupBy("key").agg(F.max_by("status", "version").alias("status"))


def _current(tables: Tables, ids: DataFrame, state: str, version: int) -> DataFrame:
    """Status and date of the invoices a batch names, as left by the earlier batches.

    Invoices are read within the range of these ids, the ledger by their keys.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    base = tables["invoices"].select("id", "status", "date").filter(_between("id", low, high)).join(ids, "id", "left_semi")
    seen = _named(ids.sparkSession, state, version, "invoice", ids.select(F.col("id").cast("string").alias("key")))
    latest = seen.select(F.col("key").alias("_key"), F.col("status").alias("_seen"))
    return base.join(latest, F.col("id").cast("string") == F.col("_key"), "left").select(
        "id", F.coalesce("_seen", "status").alias("status"), "date")


def _store(own: DataFrame, version: int, state: str) -> None:
    """Write the run of ``version``: its own rows merged with the runs before it that the carry reaches."""
    rows = own.unionByName(read_ledger(own.sparkSession, state, carried(version))).groupBy("kind", "key").agg(
        F.max_by("status", "version").alias("status"), F.max("version").alias("version"))
    write_run(rows.select("kind", "key", "status", "version"), f"{state}/ledger", version, "kind", "key")


def apply_batch(batch: DataFrame, version: int, tables: Tables, state: str) -> None:
    """One micro-batch of (request_id, id, status).

    A request that an earlier batch applied is left out, whatever happened to its invoice since; one whose
    invoice was not there may come again. A batch reads only what versions below its own wrote and overwrites its
    own, so running it again after a failure gives the same state.
    """
    spark = batch.sparkSession
    drop_merged(spark, f"{state}/ledger", version)
    asked = batch.select("request_id", "id", "status").filter(
        F.col("status").isin("draft", "confirmed")).dropDuplicates(["request_id"]).withColumn("key", F.col("request_id").cast("string"))
    asked.persist()
    try:
        applied = _named(spark, state, version, "request", asked.select("key"))
        requests = asked.join(applied.select("key"), "key", "left_anti").drop("key")
        current = _current(tables, requests.select("id").distinct(), state, version)
        entered = confirmations(status_steps(current, requests))
        groups = tables["product_groups"] if version == 0 else balances(spark, state, version - 1)
        closing = stock_balance(
            entered, tables["invoice_items"], tables["products"], tables["product_group_items"], groups)
        closing.write.mode("overwrite").parquet(f"{state}/balance/version={version}")
        known = requests.join(current.select("id"), "id", "left_semi")
        marks = known.select(F.lit("request").alias("kind"), F.col("request_id").cast("string").alias("key"), "status")
        left = compose(known, ["status"]).select(F.lit("invoice").alias("kind"), F.col("id").cast("string").alias("key"), "status")
        _store(marks.unionByName(left).withColumn("version", F.lit(version).cast("bigint")), version, state)
    finally:
        asked.unpersist()


def stock_stream(requests: DataFrame, tables: Tables, state: str, checkpoint: str) -> StreamingQuery:
    """Deduct stock on every entry into 'confirmed' in a stream of status requests, each taken once by its request_id.

    ``state`` and ``checkpoint`` belong together: versions are micro-batch numbers.
    """
    return (
        requests.writeStream.foreachBatch(lambda batch, version: apply_batch(batch, version, tables, state))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
