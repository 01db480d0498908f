"""State of a stream in sorted runs that merge like the carries of a binary counter.

The runs before micro-batch v cover the versions 0 to v - 1 like the binary digits of v; a batch merges its own rows with the
runs its carry reaches, so there are never more runs than digits, and each row is rewritten as often at most. Which
runs a batch reads and writes follows from its version alone, so a batch that is run again gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tradebook.session import remove_path

#: Rows of a file of a run.
ROWS_PER_FILE = 1 << 20

Run = tuple[int, int]


def runs(version: int) -> list[Run]:
    """(first, behind the last version) of the runs that hold everything before ``version``, the longest first."""
    out, start = [], 0
    for digit in reversed(range(version.bit_length())):
        if version >> digit & 1:
            out.append((start, start + (1 << digit)))
            start += 1 << digit
    return out


def written_run(version: int) -> Run:
    """The run that micro-batch ``version`` writes: the one that ends with it."""
    return runs(version + 1)[-1]


def carried(version: int) -> list[Run]:
    """The runs before ``version`` that its own run takes in."""
    return [run for run in runs(version) if run[0] >= written_run(version)[0]]


def run_path(folder: str, run: Run) -> str:
    return f"{folder}/{run[0]}-{run[1]}"


def read_runs(spark: SparkSession, folder: str, some: list[Run], schema: StructType | str) -> DataFrame:
    if not some:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[run_path(folder, run) for run in some])


def write_run(rows: DataFrame, folder: str, version: int, *order: str) -> None:
    """Write the run of ``version``, sorted; what an earlier try of it wrote is replaced."""
    rows.sort(*order).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(
        run_path(folder, written_run(version)))


def drop_merged(spark: SparkSession, folder: str, version: int) -> None:
    """Remove what the batch before ``version`` merged; to be called by ``version``, as that batch is committed then."""
    if version:
        for run in set(runs(version - 1)) - set(runs(version)):
            remove_path(spark, run_path(folder, run))


def newest(spark: SparkSession, folder: str) -> list[Run]:
    """The runs behind the last batch that was written whole; none before the first."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(make(folder)):
        return []
    names = [found.getPath().getName() for found in files.listStatus(make(folder))]
    done = [name for name in names if files.exists(make(f"{folder}/{name}/_SUCCESS"))]
    return runs(max((int(name.split("-")[1]) for name in done), default=0))
