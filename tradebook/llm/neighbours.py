"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into parts of equal size with few
edges between them. A small classifier learns to tell the part from the vector. It puts every vector of the
table into one part and names the most probable parts of every query; these are searched exactly. How many
are probed is measured on the sample, for a wanted recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import shuffles, small_batches
from tradebook.session import pinned

K = 20
#: Vectors the graph, the classifier and the number of probes are fitted on, at most.
SAMPLE = 8192
#: Neighbours of each vector in the graph.
DEGREE = 20
#: Rows a part should hold; there are never more parts than SAMPLE / 32.
ROWS_PER_PART = 1024
#: Share of the sample's graph that the probes must reach.
RECALL = 0.93
#: Candidates that a task compares at once, and queries that one task answers.
BLOCK = 4096
QUERY_BLOCK = 1 << 20
SEED = 5
#: One sample vector in so many is kept out of the training.
HELD = 8


def usable(vector: Column) -> Column:
    """Not null, not zero, and no component null, infinite or not a number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, v array<double>) of the usable vectors of the most frequent length.

    ``row`` names a row: those that share an id all stay. Inner products are only defined between vectors of one length.
    The numbers hold for what is written from here; write it once before it is read twice.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kept = rows if length is None else rows.where(F.size("v") == length["n"])
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "v")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def graph(spark, points: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest other points of each point, exactly, in blocks of rows."""
    n, shared = len(points), spark.sparkContext.broadcast(points)
    step = 512

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = shared.value
        for batch in batches:
            for start in batch["id"]:
                own = np.arange(start, min(start + step, n))
                near = points[own] @ points.T
                near[np.arange(len(own)), own] = -np.inf
                best = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
                yield pd.DataFrame({"row": own, "near": best.astype(np.int64).tolist()})

    found = spark.range(0, n, step, -(-n // step)).mapInPandas(block, "row long, near array<long>").toPandas().sort_values("row")
    return np.array(found["near"].to_list(), dtype=np.int64)


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part of each point: recursive cuts into equal halves along a smoothed random value, so that
    neighbours stay together, then swaps of the pairs that gain most."""
    out = np.zeros(len(near), np.int64)
    todo = [(np.arange(len(near)), 0, parts)]
    while todo:
        members, first, count = todo.pop()
        if count == 1:
            out[members] = first
            continue
        local = np.full(len(near), -1)
        local[members] = np.arange(len(members))
        source, target = np.repeat(np.arange(len(members)), near.shape[1]), local[near[members]].ravel()
        inside = target >= 0
        source, target = np.append(source[inside], target[inside]), np.append(target[inside], source[inside])
        weight = np.maximum(np.bincount(source, minlength=len(members)), 1)
        value = rng.standard_normal(len(members))
        for _ in range(40):
            value -= np.average(value, weights=weight)
            value = 0.5 * value + 0.5 * np.bincount(source, value[target], len(members)) / weight
            value /= max(np.linalg.norm(value), 1e-300)
        half = len(members) * (count // 2) // count
        left = np.zeros(len(members), bool)
        left[np.argsort(value, kind="stable")[:half]] = True
        for _ in range(10):
            agree = np.bincount(source, left[source] == left[target], len(members))
            gain = weight - 2 * agree
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            pairs = min(len(a), len(b))
            good = int(np.sum(gain[a[:pairs]] + gain[b[:pairs]] > 0)) // 4  # few at once: neighbours move together
            if not good:
                break
            left[a[:good]], left[b[:good]] = False, True
        todo += [(members[left], first, count // 2), (members[~left], first + count // 2, count - count // 2)]
    return out


class Classifier:
    """One hidden layer; soft labels are the parts of a point and its neighbours."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 25):
        wide, parts = points.shape[1], labels.shape[1]
        self.scale = 1.0 / max(np.sqrt(np.mean(points ** 2)), 1e-300)
        self.w = [rng.standard_normal((wide, hidden)) / np.sqrt(wide), np.zeros(hidden),
                  rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(points))
            for at in range(0, len(order), 256):
                x, y = points[order[at:at + 256]] * self.scale, labels[order[at:at + 256]]
                h = np.maximum(x @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
                back = (d @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    self.w[i] -= 0.003 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)

    def ranked(self, points: np.ndarray) -> np.ndarray:
        """The parts of each point, the most probable first."""
        h = np.maximum(points * self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def part_count(rows: int) -> int:
    """Parts of about ROWS_PER_PART rows, two at least as soon as there are two rows a part, and at most one for each 32
    vectors the classifier is fitted on."""
    return 1 if rows < 4 else max(2, min(rows // ROWS_PER_PART, SAMPLE // 32))


def fit(vectors: DataFrame, rows: int, recall: float = RECALL) -> tuple[Classifier | None, int, int]:
    """The classifier, the number of parts and the number of parts to probe; under four rows there is one part.

    One vector in HELD of the sample is kept out of the training: the number of probes is what these need to
    reach the wanted share of their neighbours.
    """
    spark, parts = vectors.sparkSession, part_count(rows)
    if parts < 2:
        return None, 1, 1
    picked = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toPandas()
    points, rng = matrix(picked["v"]), np.random.default_rng(SEED)
    degree = min(DEGREE, len(points) - 1)
    near = graph(spark, points, degree)
    part = balanced_parts(near, parts, rng)
    labels = np.zeros((len(points), parts))
    np.add.at(labels, (np.repeat(np.arange(len(points)), degree), part[near].ravel()), 1.0 / (2 * degree))
    labels[np.arange(len(points)), part] += 0.5
    held = np.arange(len(points)) % HELD == HELD - 1
    if not held.any():
        held[-1] = True
    model = Classifier(points[~held], labels[~held], rng)
    # as in the search: a vector lies in the part it is given by the classifier
    first = model.ranked(points)[:, 0]
    place = np.argsort(model.ranked(points[held]), axis=1)  # place[i, p]: when held-out point i probes part p
    when = place[np.arange(held.sum())[:, None], first[near[held]]].ravel()
    reached = np.cumsum(np.bincount(when, minlength=parts)) / len(when)
    return model, parts, int(np.searchsorted(reached, recall)) + 1


def enough(sizes: list[int], probes: int, k: int) -> int:
    """At least ``probes`` parts, and so many that even the smallest ones hold ``k`` rows beside the query's own."""
    held = np.cumsum(sorted(sizes))
    return min(max(probes, int(np.searchsorted(held, k + 1)) + 1), len(sizes))


def nearest(query: np.ndarray, query_row: np.ndarray, points: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query_row, ids, scores) of the ``k`` other points with the largest inner product, ties to smaller ids.

    Products are first taken by matrix, then again row by row for what comes near the k-th, so that
    equal vectors get equal scores.
    """
    out = []
    for at in range(0, len(query), 256):
        some = query[at:at + 256]
        rough = some @ points.T
        rough[query_row[at:at + 256, None] == row[None, :]] = -np.inf
        size = min(k, len(ids))
        last = np.partition(rough, len(ids) - size, axis=1)[:, len(ids) - size]
        for found, own, least, name in zip(rough, some, last, query_row[at:at + 256].tolist()):
            slack = 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else 0.0
            close = np.flatnonzero((found >= least - slack) & (found > -np.inf))
            score = (points[close] * own).sum(axis=1)
            order = np.lexsort((ids[close], -score))[:k]
            out.append((name, ids[close][order].tolist(), score[order].tolist()))
    return out


def search(vectors: DataFrame, queries: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of every row of ``vectors`` (row, id, v) that ``queries`` picks.

    Only the query's own row is no candidate; with fewer candidates than ``k`` all are given. Parts of more than BLOCK rows are
    cut into blocks, and more queries than QUERY_BLOCK into as many turns, so that no task holds
    a whole hot part. An empty table gives an empty one. Broadcast: the classifier.
    """
    spark = small_batches(vectors.sparkSession, 2048)
    rows, asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    model, parts, probes = fit(vectors, rows, recall)
    shared = spark.sparkContext.broadcast(model)

    def routed(count: int):
        @F.pandas_udf("array<int>")
        def route(parts_of: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            for v in parts_of:
                found = model.ranked(matrix(v))[:, :count] if model else np.zeros((len(v), 1))
                yield pd.Series(list(found.astype(np.int32)))

        return route("v")

    placed = pinned(vectors.withColumn("part", routed(1)[0]))
    sizes = [0] * parts
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["part"]] = r["n"]
    blocks = [max(1, -(-n // BLOCK)) for n in sizes]
    turns = max(1, -(-asked // QUERY_BLOCK))
    of_part = F.array(*map(F.lit, blocks))
    candidates = (
        placed.withColumn("block", F.pmod(F.xxhash64("row"), of_part[F.col("part")]).cast("int"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        .select("part", "block", "turn", F.lit(0).alias("kind"), "row", "id", "v")
    )
    probing = (
        placed.where(queries).select("row", "id", "v", F.explode(routed(enough(sizes, probes, k))).alias("part"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), of_part[F.col("part")] - 1)))
        .withColumn("turn", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(turns)).cast("int"))
        .select("part", "block", "turn", F.lit(1).alias("kind"), "row", "id", "v")
    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        points, row, ids, cell = np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            out: list[tuple] = []
            for own, some in batch.groupby(["part", "block", "turn"], sort=False):
                if own != cell:
                    held, points, cell = [], np.zeros((0, 0)), own
                stand = some[some["kind"] == 0]
                if len(stand):
                    held.append(stand)
                ask = some[some["kind"] == 1]
                if len(ask) and held:
                    if not len(points):
                        whole = pd.concat(held)
                        points, row, ids = matrix(whole["v"]), whole["row"].to_numpy(), whole["id"].to_numpy()
                    out += nearest(matrix(ask["v"]), ask["row"].to_numpy(), points, row, ids, k)
            yield pd.DataFrame(out, columns=["query_row", "ids", "scores"])

    cells = candidates.union(probing).repartition(max(shuffles(spark), sum(blocks) * turns), "part", "block", "turn")
    found = cells.sortWithinPartitions("part", "block", "turn", "kind").mapInPandas(
        answer, "query_row long, ids array<long>, scores array<double>"
    )

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, ids, scores = None, np.zeros(0, np.int64), np.zeros(0)

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"query_row": query, "rank": np.arange(1, len(ids) + 1, dtype=np.int32), "vec_id": ids, "score": scores})

        for batch in batches:
            done = []
            for name, more, found in batch.itertuples(index=False, name=None):
                if name != query:
                    if query is not None:
                        done.append(rows())
                    query, ids, scores = name, np.zeros(0, np.int64), np.zeros(0)
                ids, scores = np.append(ids, more), np.append(scores, found)
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order].astype(np.int64), scores[order]
            if done:
                yield pd.concat(done)
        if query is not None:
            yield rows()

    lists = found.repartition("query_row").sortWithinPartitions("query_row")
    best = lists.mapInPandas(merge, "query_row long, rank int, vec_id long, score double")
    names = placed.where(queries).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    vectors = pinned(vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(vectors, F.col("id") % 20 == 0)


register("op1_neighbours", op1_neighbours)
