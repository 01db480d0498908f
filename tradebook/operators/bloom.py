"""A Bloom filter over the keys of a small batch, for the scan of a huge table.

It drops rows of the table before any shuffle; what it lets through is still joined exactly, so it never alters a result.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 3
BITS_PER_KEY = 10
#: Keys that a filter may hold: it travels in the plan, in 64 KiB at most. Larger batches are joined without one.
MOST = 1 << 15
#: Estimated bytes from which a table is worth the pass over the batch.
LARGE = 256 << 20
# Kinds whose equality is that of their bytes.
KINDS = ("string", "int", "bigint", "date")


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def may_hold(keys: DataFrame, column: str) -> Column | None:
    """Whether ``column`` of another table may equal one of the values of the one column of ``keys``.

    None when there are too many. The driver gets one word for 64 bits.
    """
    key = F.col(keys.columns[0])
    known = keys.filter(key.isNotNull())
    number = known.limit(MOST + 1).count()
    if number > MOST:
        return None
    bits = max(64, 1 << (number * BITS_PER_KEY - 1).bit_length()) if number else 64
    place = known.select(F.explode(F.array(*_places(key, bits))).alias("place"))
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int"))
    words = dict(place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(mark)).collect())
    row = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")  # folded to a constant
    tests = [
        F.getbit(F.get(row, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(F.col(column), bits)]
    return functools.reduce(operator.and_, tests)


def narrowed(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of a large ``table`` that may meet ``keys``; a smaller one, or one of other kinds, stays as it is."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    kinds = {table.schema[column].dataType.simpleString(), keys.schema[0].dataType.simpleString()}
    if size < LARGE or len(kinds) > 1 or not kinds <= set(KINDS):
        return table
    test = may_hold(keys, column)
    return table if test is None else table.filter(test)
