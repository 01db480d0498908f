"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: the shortest string not yet in the dictionary is the next phrase
and enters it. The smallest hashes of the phrase set are the fingerprint, and the share two
fingerprints have in common estimates how alike the phrase sets are - and so, how well one text would compress with the other's
dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import shuffles, small_batches

#: Hashes in a fingerprint.
SIZE = 128
SEED = 11
#: The dictionary starts anew after so many code points, so that no text outgrows a worker.
BLOCK = 1 << 22


class Parse:
    """A parse that can go on from a copy: the dictionary, the open phrase, and the smallest hashes of closed blocks."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.open, self.length = "", 0
        self.done: np.ndarray = np.zeros(0, np.uint32)
        self.fresh: list[str] = []

    def copy(self) -> Parse:
        self.hash()
        other = Parse()
        other.seen, other.open, other.length, other.done = set(self.seen), self.open, self.length, self.done
        return other

    def hash(self) -> None:
        """Fold the new phrases' hashes into the smallest ones."""
        if self.fresh:
            found = np.fromiter((xxhash.xxh32_intdigest(p, SEED) for p in self.fresh), np.uint32, len(self.fresh))
            self.done = np.unique(np.append(self.done, found))[:SIZE]
            self.fresh = []

    def feed(self, text: str) -> Parse:
        while text:
            part, text = text[:BLOCK - self.length], text[BLOCK - self.length:]
            seen, add, fresh, phrase = self.seen, self.seen.add, self.fresh.append, self.open
            for char in part:
                phrase += char
                if phrase not in seen:
                    add(phrase)
                    fresh(phrase)
                    phrase = ""
            self.open, self.length = phrase, self.length + len(part)
            if self.length == BLOCK:
                self.hash()
                self.seen, self.open, self.length = set(), "", 0
        return self

    def sketch(self) -> np.ndarray:
        """The smallest hashes, rising; an open phrase is in the dictionary already."""
        self.hash()
        return self.done


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of the SIZE smallest hashes of both together that are in both; 1 for two empty texts."""
    both = np.sort(np.concatenate([one, other]))
    if not len(both):
        return 1.0
    again = both[1:] == both[:-1]
    distinct = both[np.append(True, ~again)]
    size = min(SIZE, len(distinct))
    return float(np.sum(both[1:][again] <= distinct[size - 1])) / size


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


class Document:
    """A text with its sketch, and its parse up to where the edit begins."""

    def __init__(self, doc_id: int | None, text: str) -> None:
        self.doc_id, self.text, self.edit = doc_id, text, len(text) // 4
        keep = len(text) - self.edit
        self.before = Parse().feed(text[:keep])
        self.sketch = self.before.copy().feed(text[keep:]).sketch()

    def row(self, following: Document) -> tuple:
        """The result row, given the document that comes next."""
        keep, new = len(self.text) - self.edit, following.text[:self.edit]
        edited = self.before.copy().feed(new).sketch()
        digest = hashlib.sha256((self.text[:keep] + new).encode()).hexdigest()
        return (self.doc_id, len(self.text), digest, written(self.sketch), written(edited),
                likeness(self.sketch, edited), likeness(self.sketch, following.sketch))


COLUMNS = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string",
           "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


def with_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, cell, tail): rows in ranges of rising doc_id, without doc_id first.

    The rows of a range's smallest doc_id are also given to the range before it (to the last, for the first), as its tail.
    Ranges come from quantiles of the ids; collected are two numbers a range.
    """
    spark = docs.sparkSession
    wanted = 4 * shuffles(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    steps = [i / wanted for i in range(1, wanted)]
    bounds = np.array(sorted(set(ids.select(F.percentile_approx("doc_id", steps, 10 * wanted)).first()[0] or [])), dtype=np.int64)
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def cell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for doc_ids in parts:
            yield pd.Series(1 + np.searchsorted(shared.value, doc_ids.to_numpy(np.int64), "left").astype(np.int32))

    number = cell(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(number).alias("cell"),
    )
    firsts = dealt.groupBy("cell").agg(F.min("doc_id").alias("first")).orderBy("cell").collect()
    tails = spark.createDataFrame(
        [(r["first"], firsts[i - 1]["cell"]) for i, r in enumerate(firsts)], "first long, cell int"
    )
    copies = dealt.drop("cell").join(F.broadcast(tails), dealt["doc_id"].eqNullSafe(tails["first"]))
    return dealt.withColumn("tail", F.lit(False)).unionByName(
        copies.select("doc_id", "text", "cell", F.lit(True).alias("tail"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the rows of ``docs`` (doc_id, text) and of their edited texts.

    Documents stand in the order of doc_id, then text; rows without doc_id come first. Edited: the last quarter of the code
    points gives way to the first as many of the next document, of the first one after the last. Null
    texts are empty; two empty fingerprints are alike (1), an empty and another are not (0). Equal rows follow each other.
    A document alone is its own next. An empty table gives an empty one; extra columns are ignored.
    """
    small_batches(docs.sparkSession, 256)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Document | None = None
        cell = None
        for batch in batches:
            out = []
            for doc_id, text, own, tail in batch.itertuples(index=False, name=None):
                if own != cell:
                    held, cell = None, own
                elif held is None:
                    continue  # further rows of a tail that is over
                now = Document(None if doc_id != doc_id else int(doc_id), text)
                if held is not None:
                    out.append(held.row(now))
                held = None if tail else now
            if out:
                yield pd.DataFrame(out, columns=list(COLUMNS)).astype({"doc_id": "Int64"})

    rows = with_ranges(docs).repartition(shuffles(docs.sparkSession), "cell").sortWithinPartitions("cell", "tail", "doc_id", "text")
    return rows.select("doc_id", "text", "cell", "tail").mapInPandas(walk, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and how near the edited and the next text are."""
    return fingerprints(table(spark, sf_dir, "documents"))


register("op7_lz_fingerprint", op7_lz_fingerprint)
