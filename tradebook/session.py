"""Session settings and the shared folder for written intermediate data."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Bytes of files that one task scans, at most.
SPLIT = 16 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on.

    Times are UTC and plain TIMESTAMP literals carry no zone. Joins carry no broadcast hints:
    AQE broadcasts a side when its measured size is under the threshold, and splits skewed
    partitions of the joins that do shuffle, even where that costs one more shuffle after the join.
    Scans read at most SPLIT bytes a task; a smaller setting of the session stays.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # A row of a file takes several times as much in a hash table of its keys; smaller splits bound a task's memory.
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(split, SPLIT)))
    return spark


def size_shuffles(spark: SparkSession, *inputs: DataFrame, per_task: int = 16 << 20) -> int:
    """Raise the number of shuffle partitions so that the inputs split into pieces of ``per_task`` bytes.

    Sizes come from the optimizer's estimate, for files their length. The number is never lowered;
    AQE merges partitions that turn out small.
    """
    sizes = [int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in inputs]
    known = sum(s for s in sizes if s < 1 << 60)  # an unknown size is given as a huge one
    wanted = min(-(-known // per_task), 100_000)
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > current:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return max(wanted, current)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else the catalog's warehouse.

    A warehouse in a ``file:`` folder is only shared where there is one machine; on a cluster that is an error, not a guess.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:") and not (spark.conf.get("spark.master", None) or "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder, which executors do not share")
    return warehouse


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed by ``scratch_scope`` or at the end of the program."""
    if not _WRITTEN:
        atexit.register(remove_written, 0)
    path = f"{shared_folder(spark).rstrip('/')}/tradebook-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lives in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def remove_written(since: int = 0) -> None:
    """Delete the scratch folders made after the first ``since`` ones; without a live session do nothing."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _WRITTEN[since:]:
            remove_path(spark, path)
        del _WRITTEN[since:]


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Remove on leaving what was written inside; results must have been consumed by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        remove_written(before)


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so every later reader sees the same rows.

    A written table needs one pass over ``df`` and gives later readers single columns;
    ``checkpoint()`` computes its input twice and keeps whole rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
