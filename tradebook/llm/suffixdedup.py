"""Removal of repeated byte strings by sparse suffix arrays in a logarithmic index family.

Every string of ``length`` bytes holds one anchor: the leftmost ``GRAM``-byte string in it with the
smallest hash. Equal strings hold equal anchors at equal places, so only suffixes around equal anchors have to
be compared. Neighbouring strings with the same anchor make one segment.

1. Each text gives its segments as narrow rows: anchor, digest of the segment, place.
2. Anchors are counted, copies first inside each task; segments whose anchor occurs once are done. The others are counted
   by (anchor, digest): a segment that occurs twice is covered whole.
3. Segments that differ around an equal anchor are fetched from the texts. In batches they get suffix arrays
   over their first ``length`` bytes, which are merge-scanned against the levels of a family; levels of like size
   merge. Anchors with more kinds of segments than one task should hold go by digests of the strings,
   counted by Spark.
4. Covered places are joined to the texts, which are cut there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches
from tradebook.session import pinned

LENGTH = 400
GRAM = 100
#: Bytes worked on at once; strings that begin before the end of a piece are judged whole.
PIECE = 1 << 20
#: Kinds of segments of one anchor that one task compares.
KINDS = 1000
#: Strings in a batch that gets a suffix array.
BATCH = 1 << 15
BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64
#: Stands for a missing doc_id inside the job.
NO_ID = -(1 << 63)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class Anchors:
    """Segments of a text: (first, last) string beginning, anchor place and anchor hash."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.width = length, gram, length - gram + 1
        n = PIECE + length
        self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, WORD), n)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """A hash of each ``gram`` bytes, by differences of a running sum."""
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        found = (sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1]
        found = (found ^ (found >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(27))

    def segments(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(text) - self.length + 1, PIECE):
            found = self.hashes(np.frombuffer(text[at:at + PIECE + self.length - 1], np.uint8))
            # the high bits decide, the low ones hold the place: the leftmost of equal ones wins
            low = (found & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(found), dtype=np.uint64)
            span = 1
            while 2 * span <= self.width:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            rest = self.width - span
            low = np.minimum(low[:len(low) - rest], low[rest:])
            anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(anchor))
            first, last = np.append(0, cuts + 1), np.append(cuts, len(anchor) - 1)
            place = anchor[first]
            yield first + at, last + at, place + at, found[place]


def row_key(text: bytes) -> int:
    """With the doc_id it names a row; rows equal in both hold equal texts."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 24 | (last - first) << 12 | (anchor - first)


def unpacked(span: int) -> tuple[int, int, int]:
    first = span >> 24
    return first, first + (span >> 12 & 0xFFF), first + (span & 0xFFF)


def segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, key, span, anchor, digest) of all segments of ``docs`` (doc, text)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors(length, gram)
        for batch in batches:
            parts = []
            for doc, text in zip(batch["doc"], batch["text"]):
                raw = text.encode()
                key = row_key(raw)
                for first, last, place, found in anchors.segments(raw):
                    bounds = zip(first.tolist(), last.tolist(), place.tolist())
                    digest = [xxhash.xxh3_64_intdigest(raw[a:z + length], x - a) for a, z, x in bounds]
                    parts.append(pd.DataFrame({
                        "doc": doc, "key": key, "span": packed(first, last, place), "anchor": found.view(np.int64),
                        "digest": np.array(digest, np.uint64).view(np.int64),
                    }))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return docs.mapInPandas(cut, "doc long, key long, span long, anchor long, digest long")


class Family:
    """Suffix arrays whose sizes at least halve from level to level."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Put a batch in; returns the ids, new and old, of strings met a second time."""
        order = np.argsort(strings, kind="stable")
        strings, ids = strings[order], ids[order]
        same = strings[1:] == strings[:-1]
        hit = [ids[1:][same], ids[:-1][same]]
        for level, known in self.levels:
            left, right = np.searchsorted(level, strings, "left"), np.searchsorted(level, strings, "right")
            met = right > left
            hit.append(ids[met])
            # marks from each first to each last place, summed up: the level's places that were met
            marks = np.zeros(len(level) + 1, np.int64)
            np.add.at(marks, left[met], 1)
            np.add.at(marks, right[met], -1)
            hit.append(known[np.cumsum(marks[:-1]) > 0])
        while self.levels and len(self.levels[-1][0]) < 2 * len(strings):
            level, known = self.levels.pop()
            at = np.searchsorted(level, strings) + np.arange(len(strings))
            kept = np.ones(len(level) + len(strings), bool)
            kept[at] = False
            merged, names = np.empty(len(kept), strings.dtype), np.empty(len(kept), np.int64)
            merged[at], names[at], merged[kept], names[kept] = strings, ids, level, known
            strings, ids = merged, names
        self.levels.append((strings, ids))
        return np.concatenate(hit)


def repeated_strings(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, whether each of its strings occurs again in these segments; 1 if so."""
    counts = [len(s) - length + 1 for s in segments]
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    hit, family = np.zeros(starts[-1], bool), Family()
    at = 0
    while at < len(segments):
        end = at + 1
        while end < len(segments) and starts[end + 1] - starts[at] <= BATCH:
            end += 1
        views = [
            np.lib.stride_tricks.sliding_window_view(np.frombuffer(s, np.uint8), length) for s in segments[at:end]
        ]
        strings = np.ascontiguousarray(np.concatenate(views)).view(f"S{length}").ravel()
        hit[family.add(strings, np.arange(starts[at], starts[end]))] = True
        at = end
    return [hit[a:z] for a, z in zip(starts[:-1], starts[1:])]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


PLACES = "doc long, key long, start long, stop long"


def compared(segments: DataFrame, length: int) -> DataFrame:
    """Covered places (doc, key, start, stop) of ``segments`` (anchor, doc, key, first, raw), by suffix arrays.

    Each anchor's segments are in one task, a bounded number; small groups share a batch.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def judge(rows: list[tuple]) -> pd.DataFrame:
            out = []
            for (_, doc, key, first, _), hit in zip(rows, repeated_strings([r[4] for r in rows], length)):
                out += [(doc, key, first + a, first + z + length) for a, z in runs(hit)]
            return pd.DataFrame(out, columns=["doc", "key", "start", "stop"], dtype="int64")

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if size > BATCH and row[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) - length + 1
        yield judge(held)

    return segments.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(scan, PLACES)


def counted(segments: DataFrame, length: int) -> DataFrame:
    """As ``compared``, for anchors of any number of segments: strings are counted by digest in Spark."""
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, doc, key, first, raw in batch.itertuples(index=False, name=None):
                two = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(raw[i:i + length]) for i in range(len(raw) - length + 1)), "<i8"
                ).reshape(-1, 2)
                yield pd.DataFrame({"d1": two[:, 0], "d2": two[:, 1], "doc": doc, "key": key,
                                    "start": np.arange(first, first + len(two))})

    strings = pinned(segments.mapInPandas(explode, "d1 long, d2 long, doc long, key long, start long"))
    twice = strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    return strings.join(twice, ["d1", "d2"], "left_semi").select("doc", "key", "start", (F.col("start") + length).alias("stop"))


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of ``wanted`` (doc, key, span, anchor, kinds) from ``docs`` (doc, key, text)."""
    asked = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("span", "anchor", "kinds")).alias("asked"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, key, text, asked in zip(batch["doc"], batch["key"], batch["text"], batch["asked"]):
                raw = text.encode()
                for one in asked:
                    first, last, _ = unpacked(one["span"])
                    out.append((one["anchor"], doc, key, first, raw[first:last + length], one["kinds"]))
            yield pd.DataFrame(out, columns=["anchor", "doc", "key", "first", "raw", "kinds"])

    return docs.join(asked, ["doc", "key"]).select("doc", "key", "text", "asked").mapInPandas(
        read, "anchor long, doc long, key long, first long, raw binary, kinds long"
    )


def repeated_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """Places (doc, key, start, stop) covering every byte of ``docs`` (doc, key, text) that lies in a string of
    ``length`` bytes that starts somewhere else, too. Places may touch and overlap."""
    segments = pinned(segment_rows(docs.select("doc", "text").where(F.octet_length("text") >= length), length, gram))
    # most anchors occur once: they are counted first, by themselves, and only the others go on
    again = pinned(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    met = pinned(segments.join(again, "anchor", "left_semi"))
    counts = pinned(met.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "key", "span")).alias("one")
    ))
    whole = met.join(counts.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    # an anchor of one kind is settled; of several, all kinds meet
    mixed = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = counts.join(mixed, "anchor")
    found = pinned(fetched(docs, several.select("one.*", "anchor", "kinds"), length))
    narrow = found.select("anchor", "doc", "key", "first", "raw")
    last = F.shiftright("span", 24) + F.shiftright("span", 12).bitwiseAND(F.lit(0xFFF))
    return (
        whole.select("doc", "key", F.shiftright("span", 24).alias("start"), (last + length).alias("stop"))
        .unionByName(compared(narrow.where(found["kinds"] <= kinds), length))
        .unionByName(counted(narrow.where(found["kinds"] > kinds), length))
    )


def covered(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of places as maximal runs; places that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_llm_doc`` and ``_llm_key``, which name a row up to equal ones."""
    @F.pandas_udf("long")
    def key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([row_key((t or "").encode()) for t in texts], dtype="int64")

    small_batches(docs.sparkSession)
    return docs.withColumn("_llm_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_llm_key", key("text"))


def with_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_llm_starts`` and ``_llm_stops`` of what repeats in the text's bytes (null: nothing).

    A null text counts as empty. Rows equal in doc_id and text are copies of each other. Extra columns stay.
    """
    keyed = with_keys(docs)
    plain = keyed.select(F.col("_llm_doc").alias("doc"), F.col("_llm_key").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated_places(plain, length, gram, kinds)
    places = found.groupBy(F.col("doc").alias("_llm_own_doc"), F.col("key").alias("_llm_own_key")).agg(
        F.collect_list(F.struct("start", "stop")).alias("_llm_places")
    )
    match = (keyed["_llm_doc"] == places["_llm_own_doc"]) & (keyed["_llm_key"] == places["_llm_own_key"])
    return keyed.join(places, match, "left").select(
        *docs.columns, F.col("_llm_places.start").alias("_llm_starts"), F.col("_llm_places.stop").alias("_llm_stops")
    )


def kept_parts(raw: bytes, starts: np.ndarray | None, stops: np.ndarray | None) -> tuple[bytes, int]:
    """What is left of ``raw``, and the number of removed runs."""
    if starts is None or not len(starts):
        return raw, 0
    first, end = covered(np.asarray(starts), np.asarray(stops))
    parts = [raw[a:z] for a, z in zip([0, *end.tolist()], [*first.tolist(), len(raw)])]
    return b"".join(parts), len(first)


def cut_column(result: str, make: Callable[[bytes, bytes, int], object], words: int = 0):
    """A column function of (text, _starts, _stops) whose values ``make`` gives from the text, the kept bytes and the runs."""
    @F.pandas_udf(result)
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, stops in parts:
            rows = []
            for text, a, z in zip(texts, starts, stops):
                raw = (text or "").encode()
                rows.append(make(raw, *kept_parts(raw, *wordy(raw, a, z, words))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in result.split(", ")])

    return cut


def wordy(raw: bytes, starts: np.ndarray | None, stops: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
    """The union of the places, without runs of fewer than ``words`` words."""
    if starts is None or not len(starts):
        return None, None
    first, end = covered(np.asarray(starts), np.asarray(stops))
    long = [len(raw[a:z].split()) >= words for a, z in zip(first.tolist(), end.tolist())]
    return first[long], end[long]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` with bytes of repeated strings of ``length`` bytes cut out of the texts and ``n_chars``, if there, counted anew.

    Only runs of such bytes with ``words`` words or more are cut. Characters that lose some of their bytes go whole.
    Rows all of whose text repeats stay, with an empty text; null texts stay null. All rows and columns stay.
    """
    cut = cut_column("text string, n long", lambda raw, kept, n: (kept.decode(errors="ignore"), n), words)
    done = with_places(docs, length, gram).withColumn("_llm_cut", cut("text", "_llm_starts", "_llm_stops"))
    text = F.when(F.col("text").isNotNull(), F.col("_llm_cut.text"))
    changed = {"text": text, "n_chars": F.when(F.col("_llm_cut.n") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))} \
        if "n_chars" in docs.columns else {"text": text}
    return done.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document once each byte inside a repeated 400-byte string is gone; ``text`` without characters cut in two."""
    docs = with_places(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = cut_column(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string",
        lambda raw, kept, n: (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")),
    )
    return docs.withColumn("_llm_cut", cut("text", "_llm_starts", "_llm_stops")).select("doc_id", "_llm_cut.*")


register("op3_suffix_dedup", op3_suffix_dedup)
