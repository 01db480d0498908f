"""Unique keys claimed and released by a batch of requests that are taken one by one.

A request claims its keys for one row; when it passes, the row's former keys are free again. What happens to it
depends on the earlier requests for the same row, for the same keys, and for the rows that hold these keys. Three steps decide
whatever a plain join can tell; the rest falls apart into small components that are folded in request order:

1. A key held by a row that no request moves stays held: its claimants are refused.
2. A request that comes first on all its keys, finds them free and is alone on its row passes and keeps them: later
   claimants are refused. A key that a large part of the batch wants is down to its first claimants after this.
3. Requests that share nothing with others pass.
4. Components of the others are found by star contraction and read in order, one request at a time, with the keys of
   one component as the only state.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.operators.components import components
from tradebook.session import pinned


def _renamed(keys: Sequence[str]) -> list:
    return [F.col(k).cast("string").alias(f"_key{i}") for i, k in enumerate(keys)]


def _claims(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """One row for each key that is not NULL: ``columns``, the key's number ``n`` and its value ``v``."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)]))
    return rows.select(*columns, each.alias("_c")).select(*columns, "_c.n", "_c.v").filter("v IS NOT NULL")


def _sure(claims: DataFrame, met: DataFrame, single: DataFrame) -> DataFrame:
    """Claims (n, v, winner) of requests that pass whatever else happens, and never let go."""
    first = claims.filter("real").groupBy("n", "v").agg(F.min("request_id").alias("first"))
    led = claims.filter("real").join(first, ["n", "v"]).withColumn("leads", F.col("first") == F.col("request_id"))
    good = led.groupBy("request_id", "id").agg(F.min("leads").alias("leads")).filter("leads").select("request_id", "id")
    good = good.join(single, "id", "left_semi").join(met, "request_id", "left_anti").select("request_id")
    return claims.join(good, "request_id", "left_semi").select("n", "v", F.col("request_id").alias("winner"))


def _folded(keys: int, sparse: bool):
    """Reads components in order, base rows first, and gives the names of refused requests."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, holders, own = None, {}, {}

        def move(row: str, values: list) -> None:
            for old in enumerate(own.get(row, ())):
                holders.get(old, set()).discard(row)
            for new in enumerate(values):
                if new[1] is not None:
                    holders.setdefault(new, set()).add(row)
            own[row] = values

        for batch in batches:
            refused = []
            for root, kind, name, row, real, *values in batch.itertuples(index=False, name=None):
                if root != component:
                    component, holders, own = root, {}, {}
                if kind == 0:
                    move(row, values)
                elif any(v is not None and holders.get((n, v), set()) - {row} for n, v in enumerate(values)):
                    refused.append(name)
                elif real:
                    before = own.get(row, [None] * keys)
                    move(row, [b if v is None and sparse else v for v, b in zip(values, before)])
            yield pd.DataFrame({"name": refused}, dtype=object)

    return fold


def clashes(requests: DataFrame, base: DataFrame | None, keys: Sequence[str], sparse: bool = False) -> DataFrame:
    """Ids of the requests that find one of their keys held by another row when all are taken in ``request_id`` order.

    ``requests``: request_id, id of the row, keys, and optionally ``real``; a request that is not real is only
    checked and changes nothing. ``base``: id and keys of the rows before the batch; None when there are none. A NULL key
    claims nothing; the row lets go of its old one, or with ``sparse`` keeps it. The result is written.
    """
    real = F.coalesce(F.col("real"), F.lit(False)) if "real" in requests.columns else F.lit(True)
    slim = pinned(requests.select(
        "request_id", F.col("id").cast("string").alias("id"), real.alias("real"), *_renamed(keys)
    ))
    spark, kind = requests.sparkSession, requests.schema["request_id"].dataType
    given, keys = keys, [f"_key{i}" for i in range(len(keys))]
    claims = _claims(slim, keys, "request_id", "id", "real")
    if base is None:
        before = spark.createDataFrame([], "id string, " + ", ".join(f"{k} string" for k in keys))
    else:
        before = base.select(F.col("id").cast("string").alias("id"), *_renamed(given))
    moved = slim.filter("real").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    held = _claims(before.withColumnRenamed("id", "holder"), keys, "holder")
    met = pinned(
        claims.join(held, ["n", "v"]).filter("holder <> id").select("request_id", "holder")
        .join(moved.select(F.col("id").alias("holder"), F.lit(True).alias("moves")), "holder", "left")
    )
    fixed = met.filter("moves IS NULL").select("request_id").distinct()
    left = claims.join(fixed, "request_id", "left_anti")
    sure = _sure(left, met, moved.filter("times = 1"))
    beaten = left.join(sure, ["n", "v"]).filter(F.col("request_id") > F.col("winner")).select("request_id").distinct()
    out = pinned(fixed.unionByName(beaten).distinct())

    rest = slim.join(out, "request_id", "left_anti")
    node = lambda mark, *columns: F.xxhash64(F.lit(mark), *columns)
    waits = met.join(out, "request_id", "left_anti").select("request_id", "holder")
    own = rest.select("request_id", node("row", F.col("id")).alias("token")).unionByName(
        _claims(rest, keys, "request_id").select("request_id", node("key", F.col("n"), F.col("v")).alias("token")))
    often = own.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("token")
    waiting = waits.select("request_id", node("row", F.col("holder")).alias("token"))
    # a row that is waited for ties its own requests to those that wait, even where it has only one
    links = pinned(
        own.join(often.unionByName(waiting.select("token")).distinct(), "token", "left_semi").select("request_id", "token").unionByName(waiting)
    )
    if links.isEmpty():
        return out
    asked = node("request", F.col("request_id"))
    roots = components(links.select(asked.alias("a"), F.col("token").alias("b")))
    placed = pinned(rest.withColumn("node", asked).join(roots, "node").drop("node"))
    root_of = placed.select("request_id", "root")
    rows = placed.filter("real").select("root", "id").unionByName(waits.join(root_of, "request_id").select("root", F.col("holder").alias("id")))
    start = rows.distinct().join(before, "id")
    columns = ["root", "kind", "request_id", "id", "real", *keys]
    events = placed.withColumn("kind", F.lit(1)).select(*columns).unionByName(
        start.withColumns({"kind": F.lit(0), "request_id": F.lit(None).cast(kind), "real": F.lit(True)}).select(*columns))
    ordered = events.repartition("root").sortWithinPartitions("root", "kind", "request_id")
    found = ordered.select("root", "kind", F.col("request_id").cast("string").alias("name"), "id", "real", *keys)
    late = found.mapInPandas(_folded(len(keys), sparse), "name string").select(F.col("name").cast(kind).alias("request_id"))
    return pinned(functools.reduce(DataFrame.unionByName, [out, late]))
