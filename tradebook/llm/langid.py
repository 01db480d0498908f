"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts of all learning rows are summed by Spark into (language, bucket) cells; the matrix of
log-probabilities, buckets x languages, is broadcast, and every text is scored in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches

#: Cells of the hash space; with the number of languages it bounds what is collected and broadcast.
BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
UNKNOWN = "und"
#: Texts are worked on in pieces of so many code points; n-grams across pieces count in full.
PIECE = 1 << 18


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(points), PIECE):
        piece = points[at:at + PIECE + max(GRAMS) - 1].astype(np.uint64)
        own = min(PIECE, len(points) - at)
        state = np.zeros(len(piece), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            state = state[:len(piece) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + piece[n - 1:] + np.uint64(n)
            if n in GRAMS:
                mixed = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed[:own] >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def count_cells(learning: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-gram counts of all rows of ``learning`` (text, lang), summed in each task first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = cells.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for found in grams(text):
                    own += np.bincount(found, minlength=BUCKETS)
        for lang, own in cells.items():
            used = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": own[used]})

    told = learning.where("text is not null and lang is not null").select("lang", "text")
    return told.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(learning: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log P(bucket | language) as a float32 matrix, buckets x languages.

    All languages count as equally likely before. Collected: at most BUCKETS rows a language.
    """
    small_batches(learning.sparkSession)
    cells = count_cells(learning).toPandas()
    langs = sorted(cells["lang"].unique().tolist())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[cells["bucket"].to_numpy(dtype=np.int64), cells["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = cells["n"]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)


def scorer(spark: SparkSession, langs: list[str], matrix: np.ndarray):
    """A column function from text to (lang_pred, score), with the model broadcast."""
    known = small_batches(spark).sparkContext.broadcast((langs, matrix))

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, matrix = known.value
        for texts in parts:
            found = [score(text, langs, matrix) for text in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"]).astype({"score": "float64"})

    return judge


def score(text: str | None, langs: list[str], matrix: np.ndarray) -> tuple[str, float]:
    """The likeliest language, and its share of the posterior.

    The log-probabilities are summed over all n-grams and divided by the square root of their
    number, as neighbouring n-grams overlap and don't tell independently. Null texts, texts
    without a letter, and all texts when nothing was learned: ``und`` and 0. Equal scores: the first
    language in alphabetical order.
    """
    if not langs or not has_letter(text):
        return UNKNOWN, 0.0
    total, n = np.zeros(len(langs)), 0
    for found in grams(text):
        # a long piece counts its buckets first: sparse rows times how often they occur
        if len(found) > 4096:
            times = np.bincount(found, minlength=BUCKETS)
            used = np.flatnonzero(times)
            total += times[used] @ matrix[used].astype(np.float64)
        else:
            total += matrix[found].sum(axis=0, dtype=np.float64)
        n += len(found)
    scaled = total / np.sqrt(n)
    odds = np.exp(scaled - scaled.max())
    best = int(np.argmax(total))
    return langs[best], float(odds[best] / odds.sum())


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; without doc_id a row is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def judged(docs: DataFrame, learning: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` plus one struct column ``_llm_language`` (lang_pred, score), from the
    text alone, by a model of ``learning`` (text, lang). An empty table gives an empty one."""
    langs, matrix = fit(learning)
    return docs.withColumn("_llm_language", scorer(docs.sparkSession, langs, matrix)(F.col("text")))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that are in no learned language: ``und``, or a score under ``least``.

    With nothing learned (no row has a language) nothing can be rejected but texts without a letter.
    """
    langs, matrix = fit(docs.where(~held_out(F.col("doc_id"))))
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = docs.withColumn("_llm_language", scorer(docs.sparkSession, langs, matrix)(F.col("text")))
    return told.where((F.col("_llm_language.lang_pred") != UNKNOWN) & (F.col("_llm_language.score") >= least)).select(*docs.columns)


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those whose id's checksum is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    told = judged(docs.select("doc_id", "held_out", "text"), docs.where(~F.col("held_out")))
    return told.select("doc_id", "held_out", "_llm_language.lang_pred", "_llm_language.score")


register("op10_language", op10_language)
