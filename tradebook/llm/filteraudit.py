"""Interaction audit of filters by min-plus removal ranks.

Spark reduces every document to the mask of the filters it fails and counts the documents of each part by mask, so
what follows handles at most 32 weighted masks a part. An order of filters is the row of positions its filters
have; over all orders these rows are the inverse permutations. Under an order, a document goes at the smallest position
of a filter it fails: the min-plus product of masks (0 where failed, infinite elsewhere) and positions. Weights scattered
over these steps give what each step removes, keeps, loses and finds already gone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches

#: The filters; bit i of a mask is set when the i-th one fails.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
CAPITALS = bytes(range(0x41, 0x5B))
SYMBOLS = re.compile(rb"[#$%&*|]")
#: What a white space byte is to bytes.split() without arguments: space, \t, \n, \v, \f, \r.
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def text_mask(text: str) -> int:
    """The filters A to D that ``text`` fails; only its different words are held at once."""
    raw = text.encode()
    words, different, at = 0, set(), 0
    while at < len(raw):
        cut = SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        some = raw[at:end].split()
        words += len(some)
        different.update(some)
        at = end
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (words < 100, 100 * len(different) < 80 * words, 100 * capitals > 10 * len(text), SYMBOLS.search(raw) is not None)
    return sum(1 << i for i, f in enumerate(failed) if f)


def judged(text: str):
    """A column of (mask, digest) for the text column."""
    @F.pandas_udf("mask int, digest binary")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            given = [t or "" for t in some]
            yield pd.DataFrame({"mask": [text_mask(t) for t in given], "digest": [hashlib.sha256(t.encode()).digest() for t in given]})

    return judge(text)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by the filters they fail, and how many are labelled so.

    Copies are found over the whole table, by the text's SHA-256. Rows are counted by (text, part, flags, doc_id) first, so that a
    text that a third of the rows share is a few rows before it meets its first doc_id.
    """
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        judged("text").alias("own"),
    ).select("doc", "part", "own.*").groupBy("digest", "mask", "part", "doc").agg(F.count(F.lit(1)).alias("n"))
    marked = rows.join(marks, rows["doc"] == marks["of"], "left").select(
        "digest", "mask", "part", "doc", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    # of each kind of row of a text: all rows, and the first doc_id with its rows
    kinds = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc").isNull(), F.col("n"))).alias("unnamed"),
        F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))).alias("low"),
    )
    # bit E goes to all rows behind the text's first doc_id; a text has few kinds of rows
    fresh = F.coalesce("unnamed", F.lit(0)) + F.when(F.col("low.doc") == F.col("first"), F.col("low.n")).otherwise(0)
    own = kinds.withColumn("first", F.min("low.doc").over(Window.partitionBy("digest"))).withColumn("fresh", fresh)
    split = own.select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("fresh").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
        )).alias("of"),
    )
    flagged = {flag: F.sum(F.when(F.col(flag), F.col("of.n")).otherwise(0)).cast("long") for flag in ("good", "toxic")}
    return split.groupBy("part", F.col("of.mask").alias("mask")).agg(
        F.sum("of.n").cast("long").alias("docs"), *(total.alias(flag) for flag, total in flagged.items())
    )


def orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of ``n`` filters, and the position of each filter in each order."""
    order = np.array(list(itertools.permutations(range(n))), np.int64).reshape(-1, n)
    return order, np.argsort(order, axis=1)


def min_plus(failed: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The step (from 0) at which each mask goes under each order; the number of filters if it stays."""
    n = position.shape[1]
    away = np.where(failed, 0, n)  # n is as good as infinite: positions end at n - 1
    return np.minimum((away[:, None, :] + position[None, :, :]).min(axis=2), n)


def audit(weights: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """One row per order and step, from ``weights`` (mask, docs, good, toxic) of one part."""
    n = len(filters)
    order, position = orders(n)
    masks = weights["mask"].to_numpy(np.int64)
    docs = weights["docs"].to_numpy(np.int64)
    failed = (masks[:, None] >> np.arange(n) & 1).astype(bool)
    gone = min_plus(failed, position)
    every = np.arange(len(order))

    def scattered(weight: np.ndarray) -> np.ndarray:
        """Weight that each order loses at each step."""
        out = np.zeros((len(order), n + 1), np.int64)
        np.add.at(out, (np.broadcast_to(every, gone.shape), gone), np.broadcast_to(weight[:, None], gone.shape))
        return out[:, :n]

    removed = scattered(docs)
    failing = docs @ failed  # of each filter, wherever the document goes
    alone = docs @ (failed & (failed.sum(axis=1) == 1)[:, None])
    share = np.zeros(n, np.int64)
    np.add.at(share, order.ravel(), removed.ravel())
    names = ["".join(filters[f] for f in row) for row in order.tolist()]
    return pd.DataFrame({
        "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1), len(order)),
        "kept": (docs.sum() - np.cumsum(removed, axis=1)).ravel(), "removed": removed.ravel(),
        "redundant": (failing[order] - removed).ravel(), "unique_fails": alone[order].ravel(),
        "good_lost": scattered(weights["good"].to_numpy(np.int64)).ravel(),
        "toxic_lost": scattered(weights["toxic"].to_numpy(np.int64)).ravel(), "shapley": share[order].ravel(),
    })


AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of every part of ``docs`` (doc_id, text, lang) under all orders of the five filters.

    Null texts are empty and null languages are the part "". Rows that repeat a doc_id and its text are no copies of each other;
    rows without doc_id are never copies and no row is a copy of them. A doc_id labelled more than once has
    every flag that one of its labels has. Extra columns are ignored; an empty table gives no rows.
    """
    counts = failures(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks"))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, masks in zip(batch["part"], batch["masks"]):
                rows = audit(pd.DataFrame([m if isinstance(m, dict) else m.asDict() for m in masks]))
                rows.insert(0, "part", part)
                yield rows

    return counts.mapInPandas(report, AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order, for every language."""
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""WITH marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  words AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
      FROM words LEFT JOIN marks USING (doc_id)),
  masks AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM judged GROUP BY part, f),
  letters AS (SELECT unnest(range(1, 6)) AS i),
  orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
             WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
  gone AS (SELECT part, o, f, n, good, toxic, coalesce(list_position(list_transform(o, lambda x: f[x]), true), 6) AS gone_at FROM masks, orders),
  steps AS (SELECT part, o, step, o[step] AS own, cast(sum(n) FILTER (WHERE gone_at > step) AS bigint) AS kept,
      cast(sum(n) FILTER (WHERE gone_at = step) AS bigint) AS removed, cast(sum(n) FILTER (WHERE f[o[step]] AND gone_at < step) AS bigint) AS redundant,
      cast(sum(n) FILTER (WHERE f[o[step]] AND len(list_filter(f, lambda x: x)) = 1) AS bigint) AS unique_fails,
      cast(sum(good) FILTER (WHERE gone_at = step) AS bigint) AS good_lost, cast(sum(toxic) FILTER (WHERE gone_at = step) AS bigint) AS toxic_lost
      FROM gone, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step)
  SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, cast(step AS integer) AS step,
         coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
         coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
         cast(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS bigint) AS shapley
  FROM steps"""
register("op13_filter_audit", op13_filter_audit, ORACLE)
