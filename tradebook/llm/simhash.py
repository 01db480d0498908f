"""SimHash near-duplicates: fingerprints, and links by the generalised pigeonhole principle.

Bits that go together are grouped into one part, so that the parts are as independent as can be.
Two fingerprints at most ``most`` bits apart must, for thresholds t with sum(t) = most - parts + 1,
differ in at most t bits in some part (-1: the part is not probed). A dynamic programme chooses
the thresholds with the fewest candidates plus probes, estimated on a bounded sample of the
fingerprints. Candidates meet in buckets, are verified over all 64 bits, and leave as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import concatenated, shuffles, small_batches
from tradebook.llm.components import components
from tradebook.session import pinned

BITS = 64
SHINGLE = 3
MOST = 3
SEED = 42
#: Fingerprints that the estimate and the grouping of bits look at, at most. They decide the cost, not the result.
SAMPLE = 2048
#: Rows of a bucket that one task compares with as many others.
BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        piece = hashes[at:at + (1 << 14)]
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) of every row of ``docs``, and the columns ``more``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), sign("text").alias("fp"), *more)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """All 64 bits in ``parts`` groups of near equal size; a group takes the bits most correlated with it."""
    if len(sample) > 2:
        with np.errstate(invalid="ignore", divide="ignore"):
            tied = np.abs(np.nan_to_num(np.corrcoef(bits_of(sample).astype(float).T)))
    else:
        tied = np.zeros((BITS, BITS))
    left, groups = set(range(BITS)), []
    for part in range(parts):
        room = -(-len(left) // (parts - part))
        group = [min(left)]
        left.remove(group[0])
        while len(group) < room:
            best = max(sorted(left), key=lambda b: tied[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def masks(groups: list[list[int]]) -> list[int]:
    return [sum(1 << b for b in group) for group in groups]


def allocate(sample: np.ndarray, groups: list[list[int]], rows: int, most: int) -> tuple[float, list[int]]:
    """The estimated cost of the best thresholds, and these: one a part, -1 to most, sum most - parts + 1.

    The cost of threshold t in a part: the row pairs within t bits there, plus the probes.
    """
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    cost = []
    for group, mask in zip(groups, masks(groups)):
        part = sample.view(np.uint64) & np.uint64(mask)
        near = np.zeros(most + 1)
        for shift in range(1, len(part)):
            far = np.bitwise_count(part[shift:] ^ part[:-shift])
            near += np.bincount(far, minlength=most + 1)[:most + 1]
        near = np.cumsum(near)
        # a part of w bits that no sampled pair shares still holds about one pair in 2^w
        chance = np.cumsum([comb(len(group), t) for t in range(most + 1)]) / 2.0 ** len(group)
        share = np.maximum(near / pairs, chance)
        probes = np.cumsum([comb(len(group), t) for t in range(most + 1)])
        cost.append([0.0, *(share * rows * rows / 2 + 8.0 * rows * probes)])
    # best[s]: the cheapest thresholds of the parts so far that sum to s
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, price in enumerate(part, start=-1):
                if total + t not in step or step[total + t][0] > spent + price:
                    step[total + t] = (spent + price, [*chosen, t])
        best = step
    return best[most - len(groups) + 1]


def plan(sample: np.ndarray, rows: int, most: int = MOST) -> tuple[list[int], list[int]]:
    """Bit masks of the parts and their thresholds, for as many parts as cost least."""
    tried = []
    for parts in range(1, most + 2):
        groups = grouped_bits(sample, parts)
        price, thresholds = allocate(sample, groups, rows, most)
        tried.append((price, masks(groups), thresholds))
    _, found, thresholds = min(tried, key=lambda t: t[0])
    return found, thresholds


def variants(mask: int, threshold: int) -> list[int]:
    """What to flip in a part to reach every value within ``threshold`` bits, 0 first."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(chosen) for t in range(threshold + 1) for chosen in combinations(bits, t)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Forest:
    """Union-find over positions; ``keep`` gives the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.up[at]
        while not np.array_equal(found, higher := self.up[found]):
            found = higher
        return found

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def keep(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        apart = self.roots(left) != self.roots(right)
        out = []
        for a, b in zip(left[apart].tolist(), right[apart].tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def linked(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """A forest of the links inside the buckets of one partition.

    ``rows``: bucket (several columns folded to ``b1``, ``b2``), fp, base; a pair is judged when one side is a base.
    Sorted by bucket, row i meets rows i + 1, i + 2, ... of its bucket, one shift at a time.
    """
    if len(rows) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    rows = rows.sort_values(["b1", "b2"], ignore_index=True)
    b1, b2, base = rows["b1"].to_numpy(), rows["b2"].to_numpy(), rows["base"].to_numpy()
    values, node = np.unique(rows["fp"].to_numpy(), return_inverse=True)
    fp = rows["fp"].to_numpy().view(np.uint64)
    forest, edges = Forest(len(values)), []
    live, shift = np.arange(len(rows) - 1), 0
    while len(live):
        shift += 1
        live = live[live + shift < len(rows)]
        other = live + shift
        live = live[(b1[live] == b1[other]) & (b2[live] == b2[other])]
        other = live + shift
        near = (base[live] | base[other]) & (np.bitwise_count(fp[live] ^ fp[other]) <= most)
        edges += forest.keep(node[live[near]], node[other[near]])
    found = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})


def links(distinct: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all of ``distinct`` (fp) at most ``most`` bits apart.

    Buckets of more than ``block`` rows are cut into pieces, and every two pieces meet in a task of their
    own. Edges that the rows of one task already connect are left out, so a dense group of n
    fingerprints gives no n * n rows.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    picked = [r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    found, thresholds = plan(np.array(picked, dtype=np.int64), rows, most)
    probes = []
    for part, (mask, threshold) in enumerate(zip(found, thresholds)):
        if threshold >= 0:
            flips = F.array(*(F.lit(signed(v)) for v in variants(mask, threshold)))
            value = F.col("fp").bitwiseAND(F.lit(signed(mask)))
            probes.append(distinct.select(
                "fp", F.lit(part).alias("part"), F.posexplode(flips).alias("flip", "bits"), value.alias("value")
            ).select("fp", "part", F.col("value").bitwiseXOR(F.col("bits")).alias("value"), (F.col("flip") == 0).alias("base")))
    probed = probes[0]
    for more in probes[1:]:
        probed = probed.unionByName(more)
    big = (
        probed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        .select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("pieces"))
    )
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    dealt = (
        probed.join(big, ["part", "value"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("own", own).withColumn("other", other)
        .select(
            "fp", "base", F.col("value").alias("b1"),
            (F.col("part") * F.lit(1 << 40) + F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other")).alias("b2"),
        )
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield linked(concatenated(batches, ["fp", "base", "b1", "b2"]), most)

    spread = dealt.repartition(max(shuffles(spark), -(-rows // 500_000) * 4), "b1", "b2")
    return spread.mapInPandas(judge, "a long, b long").distinct()


def grouped(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` (doc_id, fp and more) plus ``component_id`` and the fingerprint ``root`` that is one to a component."""
    distinct = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return rows.join(labels, rows["fp"] == labels["_fp"]).select(*rows.columns, "component_id", "root")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints at most ``most`` bits apart. Texts without words and nulls
    share fingerprint 0. Repeated rows stay; rows without doc_id get a component but never name one.
    Other columns are ignored. An empty table gives an empty one.
    """
    return grouped(pinned(fingerprints(docs, shingle)), most).drop("root")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one that gives the group its smallest doc_id.

    A doc_id with different texts is judged text by text; one group keeps one of them. Rows that repeat doc_id and text
    become one. Rows without doc_id are kept: nothing names them. All columns stay.
    """
    named = docs.withColumn("_llm_name", F.xxhash64("text"))
    groups = grouped(pinned(fingerprints(named, shingle, "_llm_name")), most)
    # a doc_id may name rows of several groups: what is kept is the row, not the doc_id
    keep = groups.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "_llm_name")).alias("own"))
    match = (named["doc_id"] == F.col("own.doc_id")) & (named["_llm_name"] == F.col("own._llm_name"))
    kept = named.join(keep, match, "left_semi").dropDuplicates(["doc_id", "_llm_name"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


register("op8_simhash", op8_simhash)
