"""Vector codes by product quantization, in exact integers.

Components become integers and vectors are cut into parts. Every part goes to the nearest entry of its part's codebook,
and entries move to the floor of their parts' mean. Distances come from matrix products: integers are broken
into limbs so small that a product of limb matrices stays below 2^53, where float64 is exact; the products are put
together again in int64 (in Python integers where that could overflow), and the first smallest distance wins.

A round is one scan: each task sums the parts of its rows by entry, Spark adds the sums up. Only codebooks, whose size
does not depend on the number of rows, reach the driver and are broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches
from tradebook.session import pinned

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Bits of a piece of a sum on its way through Spark.
PIECE_BITS = 31


def limb_bits(width: int) -> int:
    """Bits of a limb: ``width`` products of two limbs sum up to less than 2^53."""
    return (53 - max(width - 1, 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 matrices with ``values = sum(limb << (bits * i))``; the last one carries the sign."""
    out, most = [], int(np.abs(values).max()) if values.size else 0
    while most >= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values, most = values >> bits, (most >> bits) + 1
    return [*out, values.astype(np.float64)]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of integer matrices, exactly; the entries must fit the matrices' type."""
    bits = limb_bits(left.shape[1])
    total = np.zeros((len(left), len(right)), left.dtype)
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(limbs(right, bits)):
            total += (a @ b.T).astype(np.int64).astype(left.dtype) << (bits * (i + j))
    return total


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries`` for every row, ties to the lower index."""
    own = (vectors * vectors).sum(axis=1)
    away = (entries * entries).sum(axis=1)[None, :] - 2 * products(vectors, entries)
    index = np.argmin(away, axis=1)
    return index, own + away[np.arange(len(vectors)), index]


def scaled(rows: pd.Series, width: int, most: int) -> np.ndarray:
    """floor(SCALE * x) of all components, zeros up to ``width``; int64 when all distances to entries of at most
    ``most`` fit there, else Python integers."""
    flat = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        flat[i, :len(v)] = v
    largest = max(float(np.abs(flat).max(initial=0.0)) * SCALE + 1, most)
    if 4.0 * width * largest * largest < 2.0 ** 62:
        return np.floor(flat * SCALE).astype(np.int64)
    whole = [[math.floor(x * SCALE) if abs(x) < 2.0 ** 900 else int(x) * SCALE for x in row] for row in flat.tolist()]
    return np.array(whole, dtype=object).reshape(flat.shape)


class Codebooks:
    """``entries`` Python integers for every part: parts x entries x positions."""

    def __init__(self, entries: list[list[list[int]]]) -> None:
        self.entries = entries
        self.parts, self.each = len(entries), len(entries[0][0])
        self.most = max((abs(x) for part in entries for entry in part for x in entry), default=0)

    def assigned(self, rows: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every part: the rows' integers, their entries and squared distances."""
        vectors = scaled(rows, self.parts * self.each, self.most)
        for part, entries in enumerate(self.entries):
            own = vectors[:, part * self.each:(part + 1) * self.each]
            yield own, *nearest(own, np.array(entries, dtype=vectors.dtype).reshape(-1, self.each))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def kept(df: DataFrame, vector: str) -> Column:
    """Not null, and no component null, infinite or not a number."""
    sound = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound, F.lit(False))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors of the smallest ids of ``vectors`` (id, v); None of an empty table."""
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    each = max(1, -(-width // parts))
    smallest = vectors.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    whole = scaled(pd.Series([r["v"] for r in smallest]), parts * each, 0).tolist()
    return Codebooks([[row[p * each:(p + 1) * each] for row in whole] for p in range(parts)])


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floor of the mean of the parts nearest to it; unused ones stay.

    A sum travels in pieces of 31 bits, so that no task's share overflows a long.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        entries = len(books.entries[0])
        counts = np.zeros((books.parts, entries), np.int64)
        total = np.zeros((books.parts, entries, books.each), object)
        for batch in batches:
            for part, (own, index, _) in enumerate(books.assigned(batch["v"])):
                counts[part] += np.bincount(index, minlength=entries)
                summed = np.zeros((entries, books.each), own.dtype)
                np.add.at(summed, index, own)
                total[part] += summed.astype(object)
        rows = []
        for part, entry in np.argwhere(counts).tolist():
            rows.append((part, entry, -1, 0, int(counts[part, entry])))
            for position, value in enumerate(total[part, entry].tolist()):
                piece = 0
                while not -(1 << PIECE_BITS) <= value < 1 << PIECE_BITS:
                    rows.append((part, entry, position, piece, value & ((1 << PIECE_BITS) - 1)))
                    value, piece = value >> PIECE_BITS, piece + 1
                rows.append((part, entry, position, piece, value))
        yield pd.DataFrame(rows, columns=["part", "entry", "position", "piece", "value"], dtype="int64")

    shares = vectors.select("v").mapInPandas(sums, "part long, entry long, position long, piece long, value long")
    added = shares.groupBy("part", "entry", "position", "piece").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for part, entry, position, piece, value in added.collect():
        cell = found.setdefault((part, entry), {})
        cell[position] = cell.get(position, 0) + (int(value) << (PIECE_BITS * piece))
    return Codebooks([
        [
            [found[p, e][i] // found[p, e][-1] for i in range(books.each)] if (p, e) in found else entry
            for e, entry in enumerate(entries)
        ]
        for p, entries in enumerate(books.entries)
    ])


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows of ``vectors`` (id, v); None of an empty table."""
    small_batches(vectors.sparkSession)
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(vectors, books)
    return books


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` (with v) plus ``code`` and ``error``; an error that no long holds is null."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("code string, error long")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            indexes, error = [], 0
            for _, index, away in shared.value.assigned(rows):
                indexes.append(index)
                error = error + away.astype(object)
            codes = [bytes(c).hex() for c in np.stack(indexes, axis=1).astype(np.uint8)]
            errors = [int(e) if e < 1 << 63 else None for e in error]
            yield pd.DataFrame({"code": codes, "error": pd.array(errors, "Int64")})

    return vectors.withColumn("_llm_code", encode("v")).select("*", "_llm_code.*").drop("_llm_code")


def compressed(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(``key``, code, error, label_error, codebooks_sha256) of all usable rows of ``df``.

    Rows with a null vector, or one with null or non-finite components, go. Repeated rows stay; an id given more than
    once begins one entry, with its smallest vector, and a null id comes after all others. Vectors of other lengths
    are filled up with zeros to the longest one, and that to a multiple of the parts. With fewer ids than entries there are
    fewer entries. Errors and sums of errors that no long holds are null. Extra columns are ignored; an empty table
    gives an empty one.
    """
    rows = df.where(kept(df, vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")
    )
    books = trained(rows.select("id", "v"))
    digest = "" if books is None else books.digest()
    found = rows.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}) if books is None else coded(rows, books)
    found = pinned(found.select("id", "label", "code", "error"))
    whole = F.count(F.lit(1)) == F.count("error")
    sums = found.groupBy(F.col("label").alias("of")).agg(
        F.when(whole, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error")
    )
    return found.join(sums, found["label"].eqNullSafe(sums["of"]), "left").select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, errors by label, and the digest of the codebooks."""
    return compressed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _near(n: int) -> str:
    """SQL: the nearest entry of codebook ``n`` for every part."""
    return f"""near{n} AS (
    SELECT vec_id, p, min(away * 64 + e) % 64 AS e, min(away * 64 + e) // 64 AS away FROM (
      SELECT parts.vec_id, parts.p, book.e,
             cast(list_sum(list_transform(list_zip(parts.v, book.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS hugeint) AS away
      FROM parts JOIN book{n} AS book ON parts.p = book.p) GROUP BY vec_id, p)"""


def _book(n: int) -> str:
    """SQL: codebook ``n``, from the one before."""
    return f"""book{n} AS (
    SELECT book.p, book.e, coalesce(moved.v, book.v) AS v FROM book{n - 1} AS book LEFT JOIN (
      SELECT p, e, list((s - (s % c + c) % c) // c ORDER BY i) AS v FROM (
        SELECT p, e, i, sum(x) AS s, count(*) AS c FROM (
          SELECT parts.p, near.e, unnest(parts.v) AS x, unnest(range(len(parts.v))) AS i
          FROM parts JOIN near{n - 1} AS near ON parts.vec_id = near.vec_id AND parts.p = near.p) GROUP BY p, e, i)
      GROUP BY p, e) AS moved ON book.p = moved.p AND book.e = moved.e)"""


ORACLE = f"""WITH kept AS (
    SELECT vec_id, label, len(embedding) // 16 AS each, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS (SELECT vec_id, p, v[p * each + 1:(p + 1) * each] AS v FROM kept, range(16) AS r(p)),
  book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
  {_near(0)}, {_book(1)}, {_near(1)}, {_book(2)}, {_near(2)},
  done AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, cast(sum(away) AS bigint) AS error
           FROM near2 GROUP BY vec_id),
  digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
  SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256
  FROM done JOIN kept USING (vec_id), digest"""
register("op11_vector_codes", op11_vector_codes, ORACLE)
