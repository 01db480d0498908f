"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Texts are split into words by the tokenizer's pattern. Consecutive documents of a partition make a chunk; a text becomes the
numbers of its stretches between spaces, and the chunk has a list of its distinct words and one of its stretches as words. The
word lists are shuffled by word, so that each distinct word meets in one task, which encodes it once, and the ids go back to
the chunks, where the texts are put together by number. Hot words travel once a chunk, not once an occurrence. Lists travel
packed, as one row for each chunk and word bucket. The documents are read twice, but only the first pass looks for words.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches, spread

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points of a chunk, or a single longer text.
CHUNK = 6_000_000
#: A space before a word always begins a word of the pattern, unless more white space is around it; other spaces are cut.
UNSAFE = re.compile(r"\s (?!\S)")
CUT = re.compile(r"(?<!\s) | (?=\S)")
#: Marks that make a word of their own behind letters.
MARKS = ",.;:!?"


@functools.lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=1)
def tokens(path: str) -> list[bytes]:
    """The bytes of every token id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines]
    out = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@functools.lru_cache(maxsize=1)
def whole(path: str) -> tiktoken.Encoding:
    """The merges of the rank file for one word at a time: all of a given text counts as one word."""
    ranks = {token: rank for rank, token in enumerate(tokens(path)) if token}
    return tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def packer() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Making these costs more than a short value does, so a worker keeps them."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; numbers go byte plane by byte plane, as high bytes repeat."""
    parts = [np.array([len(a) for a in arrays], "<u4").tobytes()]
    parts += [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return packer()[0].compress(b"".join(parts))


def unsqueezed(value: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(packer()[1].decompress(value), np.uint8)
    sizes, at, out = raw[:4 * count].view("<u4"), 4 * count, []
    for size in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at:at + 4 * size].reshape(4, size).T).view("<u4").ravel())
        at += 4 * size
    return out


def ragged(flat: np.ndarray, starts: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[p]:starts[p + 1]]`` of all ``picked`` one after the other."""
    sizes = starts[picked + 1] - starts[picked]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts[picked] - (ends - sizes), sizes) + np.arange(ends[-1])]


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def words_of(text: str, before: str = "") -> list[str]:
    """The matches of the pattern in ``before + text``; a plain word with marks needs no search."""
    core = text.rstrip(MARKS)
    if core != text and core.isalpha():
        return [before + core, text[len(core):]]
    return pattern().findall(before + text)


class Chunk:
    """Each text as the numbers of its stretches between spaces where a cut is safe; equal stretches have one number, by first use.

    The stretch that begins a text is numbered apart, behind the others: it has no space before it.
    """

    def __init__(self, texts: list[str]) -> None:
        unsafe = {i: CUT.split(t) for i, t in enumerate(texts) if UNSAFE.search(t)}
        pieces = pc.split_pattern(pa.array([" " if i in unsafe else t for i, t in enumerate(texts)], pa.large_string()), " ")
        if unsafe:
            cut = pa.array([unsafe.get(i) for i in range(len(texts))], pa.large_list(pa.large_string()))
            pieces = pc.coalesce(cut, pieces.cast(cut.type))
        starts = offsets(pc.list_value_length(pieces).to_numpy())
        begins = np.zeros(starts[-1], bool)
        begins[starts[:-1]] = True
        flat = pieces.flatten()
        first, rest = flat.filter(pa.array(begins)).dictionary_encode(), flat.filter(pa.array(~begins)).dictionary_encode()
        self.first, self.rest = first.dictionary, rest.dictionary
        self.begins, numbers = first.indices.to_numpy() + len(self.rest), rest.indices.to_numpy()
        self.parts = np.split(numbers, (starts - np.arange(len(starts)))[1:-1])

    def coded(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the number of its first stretch, the count of those that earlier texts have, and the others by first use."""
        known = 0
        for begin, parts in zip(self.begins.tolist(), self.parts):
            yield np.array([begin, known]), by_first_use(parts, known)
            known = max(known, int(parts.max(initial=-1)) + 1)

    def words(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words, the word numbers of all stretches in one array, and how many each stretch has."""
        found, counts = [], []
        for before, parts in ((" ", self.rest), ("", self.first)):
            for part in parts.to_numpy(zero_copy_only=False).tolist():
                if part.isalpha():  # no search, as for most
                    found.append(before + part)
                    counts.append(1)
                else:
                    own = words_of(part, before)
                    found += own
                    counts.append(len(own))
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        raw = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        return raw, coded.indices.to_numpy().astype(np.int64), np.array(counts)


def by_first_use(numbers: np.ndarray, known: int = 0) -> np.ndarray:
    """0 for the next number that was not used yet, after ``known`` ones, else the number plus 1; zeros compress."""
    new = numbers >= np.maximum.accumulate(np.append(known, numbers[:-1] + 1))
    return np.where(new, 0, numbers + 1)


def from_first_use(steps: np.ndarray, known: int = 0) -> np.ndarray:
    """The numbers that ``by_first_use`` was given."""
    new = steps == 0
    return np.where(new, known + np.cumsum(new), steps.astype(np.int64)) - 1


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, Chunk]]:
    """(name, doc_ids, chunk); the name is a hash of the rows, so equal names mean equal word lists."""
    texts, ids, size, name = [], [], 0, xxhash.xxh3_64()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            texts.append(text or "")
            ids.append(doc_id)
            size += len(texts[-1])
            name.update(f"{doc_id} {len(texts[-1])} {texts[-1]}".encode())
            if size >= CHUNK:
                yield name.intdigest() - (1 << 63), ids, Chunk(texts)
                texts, ids, size, name = [], [], 0, xxhash.xxh3_64()
    if ids:
        yield name.intdigest() - (1 << 63), ids, Chunk(texts)


ROWS = "chunk long, bucket int, doc_id long, value binary"


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "bucket", "doc_id", "value"]).astype({"doc_id": "Int64"})


def word_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """One row for each chunk and bucket: word numbers, sizes and bytes of the words; and one of the chunk's stretches as words.

    The rows of stretches have buckets of their own, as many as the words have.
    """
    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, _, chunk in chunks(batches):
            raw, flat, counts = chunk.words()
            bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(name, buckets + name % buckets, None, squeezed(by_first_use(flat), counts))]
            for b in range(buckets):
                own = order[cuts[b]:cuts[b + 1]]
                if len(own):
                    listed = [raw[i] for i in own.tolist()]
                    held = squeezed(np.diff(own, prepend=0), np.array([len(w) for w in listed]))
                    text = packer()[0].compress(b"".join(listed))
                    out.append((name, b, None, len(held).to_bytes(4, "little") + held + text))
            yield frame(out)

    return docs.mapInPandas(lists, ROWS)


def encoded_lists(lists: DataFrame, path: str, buckets: int) -> DataFrame:
    """``lists`` with ids in place of words; a bucket is in one task, which encodes each word once. Stretches stay."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, bytes] = {}
        merged = whole(path).encode_ordinary
        for batch in batches:
            out = []
            for chunk, bucket, _, value in batch.itertuples(index=False, name=None):
                if bucket >= buckets:
                    out.append((chunk, bucket, None, value))
                    continue
                at = 4 + int.from_bytes(value[:4], "little")
                steps, sizes = unsqueezed(value[4:at], 2)
                text = packer()[1].decompress(value[at:])
                cuts = offsets(sizes).tolist()
                words = [text[a:z] for a, z in zip(cuts, cuts[1:])]
                for w in words:
                    if w not in known:
                        known[w] = array("I", merged(w.decode())).tobytes()
                found = [known[w] for w in words]
                counts = np.array([len(x) for x in found]) // 4
                out.append((chunk, bucket, None, squeezed(steps, counts, np.frombuffer(b"".join(found), "<u4"))))
            yield frame(out)

    return lists.repartition(buckets, "bucket").mapInPandas(encode, ROWS)


def coded_texts(docs: DataFrame) -> DataFrame:
    """Every text as the numbers of its chunk's stretches, no words are looked for; a bucket number behind all lists."""
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, ids, chunk in chunks(batches):
            yield frame([(name, 1 << 30, doc, squeezed(*numbers)) for doc, numbers in zip(ids, chunk.coded())])

    return docs.mapInPandas(code, ROWS)


def ids_of_stretches(lists: list[list[np.ndarray]], words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all stretches in one array and where each begins, by the encoded lists of a chunk."""
    if not lists:  # no text of the chunk has a word
        return np.zeros(0, "<u4"), offsets(counts)
    numbers = np.concatenate([np.cumsum(steps, dtype=np.int64) for steps, _, _ in lists])
    sizes = np.concatenate([n for _, n, _ in lists])
    order = np.argsort(numbers)
    own = ragged(np.concatenate([ids for _, _, ids in lists]), offsets(sizes), order)
    of_words = offsets(sizes[order])
    ends = np.append(0, np.cumsum(np.diff(of_words)[words]))
    return ragged(own, of_words, words), ends[offsets(counts)]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary) of every row of ``docs`` (doc_id, text): little-endian unsigned 32-bit ids.

    Null texts are empty and give no ids. Repeated rows stay, extra columns are ignored, an empty table gives an
    empty one. ``docs`` is read twice and must give the same partitions both times, as files do.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = spread(narrow)

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, last, held = None, -1, []
        flat, starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        for batch in batches:
            out = []
            for name, bucket, doc_id, value in batch.itertuples(index=False, name=None):
                if name != chunk:
                    chunk, last, held, flat, starts = name, -1, [], np.zeros(0, "<u4"), np.zeros(1, np.int64)
                if bucket < buckets:
                    if bucket != last:  # chunks of equal rows have equal lists
                        held.append(unsqueezed(value, 3))
                elif bucket < 1 << 30:
                    if bucket != last:
                        steps, counts = unsqueezed(value, 2)
                        flat, starts = ids_of_stretches(held, from_first_use(steps), counts)
                        held = []
                else:
                    (begin, known), steps = unsqueezed(value, 2)
                    parts = np.append(int(begin), from_first_use(steps, int(known)))
                    out.append((doc_id, ragged(flat, starts, parts).astype("<u4").tobytes()))
                last = bucket
            yield pd.DataFrame(out, columns=["doc_id", "ids"]).astype({"doc_id": "Int64"})

    rows = encoded_lists(word_lists(narrow, buckets), path, buckets).unionByName(coded_texts(narrow))
    met = rows.repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket")
    return met.mapInPandas(assemble, "doc_id long, ids binary")


def decoded(path: str):
    """A column function from ids to the bytes they stand for, by the token-byte table."""
    @F.pandas_udf("binary")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = tokens(path)
        flat, starts = np.frombuffer(b"".join(known), np.uint8), offsets(np.array([len(t) for t in known]))
        for ids in parts:
            yield pd.Series([ragged(flat, starts, np.frombuffer(i, "<u4").astype(np.int64)).tobytes() for i in ids])

    return decode


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    path = public_tokenizers.path(RANKS)
    coded = encode_documents(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded(path)("ids"), 256).alias("decoded_sha256"),
    )


register("op6_byte_bpe", op6_byte_bpe)
