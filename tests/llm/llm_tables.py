"""Small tables with nulls, repeated rows, very long texts and clashing extra columns, and brute-force versions."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river mountain Straße eau forêt señor über 12 3.5 don't it's 中文 😀 alpha beta gamma delta epsilon".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", ",", ".", "\n"]) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): odd cases first, then prose with copies and a shared passage."""
    passage = prose(7, 120)
    rows: list[tuple] = [
        (1, None, "en", None), (2, "", None, "a"), (3, "   \n\t ", "en", "a"), (4, "12 34 !!", "fr", "b"),
        (5, "one", "en", "b"), (6, "a  b\n\n c  d ", "en", "c"), (None, "without an id", "en", None),
        (8, "<|endoftext|> and <|im_start|>", "en", "c"), (9, prose(1, 9000), "en", "long"),
        (9, prose(1, 9000), "en", "long"), (10, "x" * 3000, None, "c"),
    ]
    rows += [(20 + i, prose(100 + i, 40 + 13 * i), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(25)]
    rows += [(60 + i, prose(3, 90), "de", "hot") for i in range(12)]
    rows += [(80 + i, prose(200 + i, 60) + " " + passage + " " + prose(300 + i, 50), "en", "p") for i in range(6)]
    rows += [(90 + i, prose(9, 200) + " " + WORDS[i], "en", "near") for i in range(5)]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The texts as a table of documents."""
    given = texts() if rows is None else rows
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in given], DOCUMENT)


def with_extras(docs: DataFrame) -> DataFrame:
    """Columns named like those the operators make or use inside."""
    names = ["key", "doc", "size", "shard", "fp", "component_id", "piece", "length", "number", "n", "anchor", "score", "lang_pred", "_n"]
    return docs.selectExpr("*", *(f"'extra' AS {n}" for n in names if n not in docs.columns))


def folder(spark: SparkSession, path, docs: DataFrame, name: str = "documents") -> str:
    """A data folder that holds ``docs`` as a table, for the registered queries."""
    docs.repartition(3).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
