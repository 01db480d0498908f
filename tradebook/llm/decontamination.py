"""Benchmark decontamination by winnowing.

Texts become words, and every window of words keeps the smallest hash of its grams of ``GRAM`` words. A window that a
document shares with an item has the same words, so the same grams and the same smallest one: no shared window is missed.

1. Items give their windows, each with its fingerprint; equal windows of all items become one row.
2. Documents give their distinct fingerprints, which are joined to those of the items.
3. Only documents with a common fingerprint are read again: a hit is extended to the windows that keep it,
   and these are joined to the items' windows by their words, so that a hash alone decides nothing.
4. Places of common windows are united for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches
from tradebook.session import pinned

WINDOW = 10
GRAM = 5
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Lower case for A-Z, a space for every byte that is not in a word; bytes of other letters are over 0x7F.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Stands for a missing doc_id inside the job.
NO_ID = -(1 << 63)


def plain(text: str | None) -> bytes:
    return (text or "").encode().translate(PLAIN)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word, piece by piece: a long text never stands as a list of words."""
    parts, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        words = raw[at:end if end >= 0 else len(raw)].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end if end >= 0 else len(raw)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The fingerprint of every window of ``window`` words: the smallest hash of its grams."""
    gram = min(gram, window)
    if len(words) < window:
        return np.zeros(0, np.int64)
    n = len(words) - gram + 1
    grams = np.full(n, window, np.uint64)  # windows of different lengths have fingerprints of their own
    for i in range(gram):
        grams = mixed(grams + words[i:i + n])
    width = window - gram + 1
    least = grams[:len(words) - window + 1].copy()
    for i in range(1, width):
        np.minimum(least, grams[i:i + len(least)], out=least)
    return least.view(np.int64)


def windows(raw: bytes, lengths: list[int], gram: int, wanted: set[int] | None = None) -> Iterator[tuple[int, int, int, str]]:
    """(first word, words, fingerprint, text) of the windows of ``raw`` whose fingerprint is ``wanted``."""
    hashes = word_hashes(raw)
    picked = None if wanted is None else np.array(sorted(wanted), np.int64)
    words: list[bytes] = []
    for length in lengths:
        found = fingerprints(hashes, length, gram)
        starts = np.arange(len(found)) if picked is None else np.flatnonzero(np.isin(found, picked))
        if len(starts) and not words:
            words = raw.split()
        for start, kept in zip(starts.tolist(), found[starts].tolist()):
            yield start, length, kept, b" ".join(words[start:start + length]).decode()


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(fp, words, length, items array<string>) of the different windows of ``items`` (item, text); an item of fewer
    words than a window is one window."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"]):
                raw = plain(text)
                length = min(window, len(word_hashes(raw)))
                if length:
                    out += [(fp, words, length, item) for _, length, fp, words in windows(raw, [length], gram)]
            yield pd.DataFrame(out, columns=["fp", "words", "length", "item"])

    rows = items.mapInPandas(cut, "fp long, words string, length int, item string")
    return rows.groupBy("fp", "words", "length").agg(F.collect_set("item").alias("items"))


def document_fingerprints(docs: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(doc, key, n_words, fps): the distinct fingerprints of the text's windows of all ``lengths``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, found = [], []
            for text in batch["text"]:
                hashes = word_hashes(plain(text))
                counts.append(len(hashes))
                kept = [fingerprints(hashes, length, gram) for length in lengths]
                found.append(np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc": batch["doc"], "key": batch["key"], "n_words": counts, "fps": found})

    return docs.mapInPandas(read, "doc long, key long, n_words long, fps array<long>")


def extended(docs: DataFrame, asked: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(doc, key, first, length, fp, words): the windows of ``docs`` that keep a fingerprint ``asked`` (doc, key, hits) names."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (doc, key, *found)
                for doc, key, text, hits in zip(batch["doc"], batch["key"], batch["text"], batch["hits"])
                for found in windows(plain(text), lengths, gram, set(hits.tolist()))
            ]
            yield pd.DataFrame(out, columns=["doc", "key", "first", "length", "fp", "words"])

    met = docs.join(asked, ["doc", "key"]).select("doc", "key", "text", "hits")
    return met.mapInPandas(read, "doc long, key long, first long, length int, fp long, words string")


def united(places) -> F.Column:
    """Words that the windows of ``places`` (first, length) cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(done, place):
        stop = place["first"] + place["length"]
        return F.struct(
            (done["n"] + F.greatest(F.lit(0), stop - F.greatest(place["first"], done["end"]))).cast("long").alias("n"),
            F.greatest(stop, done["end"]).cast("long").alias("end"),
        )

    return F.aggregate(F.array_sort(places), start, step, lambda done: done["n"])


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` against all of ``bench``.

    Null texts have no words. Rows equal in doc_id and text give equal rows, each as often as given. Items that repeat an
    id are one item; one without id hits words but is not named. Items without words match nothing. Extra columns are
    ignored; empty tables give no rows, or no hits. Windows of items are broadcast where Spark finds their files under its
    threshold, and shuffled beyond it.
    """
    spark = small_batches(docs.sparkSession)
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text",
    )
    marks = pinned(item_windows(bench.select(F.col("item_id").cast("string").alias("item"), "text"), window, gram))
    lengths = sorted(r["length"] for r in marks.select("length").distinct().collect())
    known = pinned(marks.select("fp").distinct())
    rows = pinned(document_fingerprints(narrow, lengths, gram))
    hits = rows.select("doc", "key", F.explode("fps").alias("fp")).join(known, "fp", "left_semi")
    asked = pinned(hits.groupBy("doc", "key").agg(F.collect_set("fp").alias("hits")))
    met = extended(narrow, asked, lengths, gram).join(marks.drop("length"), ["fp", "words"])
    of_doc = pinned(met.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("first", "length")).alias("places"), F.collect_set("items").alias("items"),
    ).select(
        "_doc", "_key", united(F.col("places")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    ))
    none = F.array().cast("array<string>")
    return rows.join(of_doc, (rows["doc"] == of_doc["_doc"]) & (rows["key"] == of_doc["_key"]), "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item, and which items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
  items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  marks AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS seen FROM (
      SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS n FROM items) WHERE n > 0)),
  lengths AS (SELECT DISTINCT n FROM marks),
  places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS seen FROM (
      SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
  met AS (SELECT places.*, item_id FROM places JOIN marks USING (n, seen)),
  hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS k FROM met) GROUP BY r),
  named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (
      SELECT DISTINCT r, cast(item_id AS varchar) AS name FROM met WHERE item_id IS NOT NULL) GROUP BY r)
  SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
         cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
register("op12_decontamination", op12_decontamination, ORACLE)
