"""Packing token pieces into sequences by minimum bin slack.

Every text is tokenized and cut into pieces. How sequences are filled depends on lengths alone, and there are at
most as many as a sequence has tokens: Spark counts the pieces of each length, and a plan over
these counts is made once, whatever the number of documents. Per kind of bin, a subset-sum dynamic programme on a
bitset finds the fullest combination with the largest length left; it is taken out as often as
the counts allow. Pieces are then numbered inside their length and look their place up.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradebook.llm.book import register, table
from tradebook.llm.common import numbered, small_batches
from tradebook.session import pinned

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Code points that are encoded at once; longer texts are cut at a space that begins a word.
PIECE = 1 << 18
#: A space between two other characters that are no white space: the split into words begins one there.
CUT = re.compile(r"(?<=\S) (?=\S)")


def alphabet() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    The merges run in tiktoken over this file's own vocabulary, at a fifth of the time: its ids are in the order of the merges,
    and a merge is then the pair whose token has the smallest id. Texts with special tokens go to the library, as do all texts
    of a file that is made otherwise.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, split = held["model"], held["pre_tokenizer"] or {}
        ids = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model.get("merges", [])]
        plain = (
            model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback", "end_of_word_suffix", "continuing_subword_prefix"))
            and held["normalizer"] is None and ids == sorted(set(ids)) and min(ids, default=0) >= 256
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        )
        self.fast = None
        if plain:
            of = alphabet()
            ranks = {bytes(map(of.__getitem__, token)): rank for token, rank in model["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return b"".join(array("I", self.fast.encode_ordinary(part)).tobytes() for part in self.stretches(text))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Kept by a worker for all its tasks."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than ``capacity``."""
    first = n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all texts of ``docs``, each with an end token after it.

    Null texts are empty: one piece of one token. Rows repeat as often as they are given.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder(path).encode(text or "") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) that fill ``room`` best, each length at most ``counts[length]`` times.

    ``reach`` has bit s set when some combination of the lengths so far sums to s; what it was before each length
    leads back to the combination. Long lengths come first and are used first.
    """
    reach, before = 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            taken = min(step, left)
            reach |= (reach << (taken * length)) & whole
            left, step = left - taken, step * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = []
    for length, reach in reversed(before):
        times = 0
        while not reach >> total & 1:
            total, times = total - length, times + 1
        if times:
            chosen.append((length, times))
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, their lengths and times) until all ``counts`` are used up."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        largest = max(left)
        rest = {**left, largest: left[largest] - 1}
        combined = dict(fullest({x: n for x, n in rest.items() if n}, capacity - largest))
        combined[largest] = combined.get(largest, 0) + 1
        repeat = min(left[x] // times for x, times in combined.items())
        out.append((repeat, sorted(combined.items(), reverse=True)))
        for x, times in combined.items():
            left[x] -= repeat * times
            if not left[x]:
                del left[x]
    return out


def places(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """For every length and range of numbers in it: the first sequence, pieces a sequence, and the offset."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for repeat, combined in patterns(counts, capacity):
        offset = 0
        for length, times in combined:
            first = used.get(length, 0)
            out.append((length, first, sequence, times, offset))
            used[length] = first + repeat * times
            offset += length * times
        sequence += repeat
    columns = ["length", "first", "sequence", "times", "offset"]
    return pd.DataFrame(out, columns=columns, dtype="int64").sort_values(["length", "first"], ignore_index=True)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (with length, and doc_id, piece, ids_crc32 as order) plus sequence_id and offset.

    Collected and broadcast is a plan over the lengths: at most ``capacity`` counts and a few rows
    for each. An empty table gives an empty one. Every piece, also a repeated one, has a place of its own.
    """
    spark = cut.sparkSession
    rows = pinned(cut)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = places(counts, capacity)
    shared = spark.sparkContext.broadcast([plan[c].to_numpy() for c in plan.columns])

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        length, first, sequence, times, offset = shared.value
        keys = length * (1 << 44) + first  # numbers inside a length stay under 2^44
        at = np.searchsorted(keys, lengths.to_numpy() * (1 << 44) + numbers.to_numpy(), "right") - 1
        inside = numbers.to_numpy() - first[at]
        return pd.DataFrame({
            "sequence_id": sequence[at] + inside // times[at],
            "offset": offset[at] + inside % times[at] * length[at],
        })

    known = numbered(rows, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "_number")
    return known.withColumn("_place", place("length", "_number")).select(*cut.columns, "_place.*")


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, public_tokenizers.path(VOCABULARY)))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces, each with its sequence of at most 2048 tokens and its place there."""
    return packed_documents(table(spark, sf_dir, "documents"))


register("op5_packing", op5_packing)
