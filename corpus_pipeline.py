"""From documents to packed training sequences: four stages, each one of the operators of ``tradebook.llm``.

Every stage takes (spark, docs, sf_dir); ``docs`` has the columns of ``documents``, and all stages but the last give
these columns back. What a stage gives is written as Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradebook.llm.langid import accepted
from tradebook.llm.packing import packed_documents
from tradebook.llm.simhash import MOST, SHINGLE, one_of_each
from tradebook.llm.suffixdedup import without_repeats
from tradebook.session import pinned

#: Bytes of a string that counts as repeated, its anchor's bytes, and the words a repeated run must have to go.
PASSAGE = 200
PASSAGE_GRAM = 50
PASSAGE_WORDS = 51


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts, texts without letters and doubtful ones go.

    Repeated rows are judged alike, an empty table stays empty, extra columns stay.
    """
    return accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Rows without doc_id stay, rows that repeat doc_id and text become one, an empty table stays empty, extra columns stay.
    """
    return one_of_each(docs, SHINGLE, MOST)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words that occur again; n_chars follows the text.

    What repeats is found by strings of PASSAGE bytes, and cut where a run of it has PASSAGE_WORDS words: shorter
    common lines stay. Both copies go, also inside one text. Null texts stay null, a text that is all repeated becomes empty,
    extra columns stay, an empty table stays empty; rows equal in doc_id and text are copies of each other.
    """
    return without_repeats(docs, PASSAGE, PASSAGE_GRAM, PASSAGE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and places.

    Null texts are one end token, repeated rows are packed as often as given, an empty table gives no pieces, extra columns go.
    """
    return packed_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("best_fit_packing", packed),
]

#: No stage but filtering can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
