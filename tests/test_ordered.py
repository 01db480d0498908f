"""Ordered computations with one key owning most rows, against plain loops."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.small import rows
from tradebook.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(30)}", i, Decimal(rng.randrange(1000)) / 100,
             rng.choice(["a", "b", "c"])) for i in range(3000)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, n long, v decimal(20,2), s string").repartition(5)


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Small data would be coalesced into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_running_sum(skewed):
    data, df = skewed
    want = {}
    for group in by_key(data).values():
        total = Decimal(0)
        for _, n, v, _ in group:
            total += v
            want[n] = total
    got = {r["n"]: r["out"] for r in ordered.running_sum(df, ["k"], ["n"], "v", "out").collect()}
    assert got == want


def test_positions_and_previous(skewed):
    data, df = skewed
    place, before = {}, {}
    for group in by_key(data).values():
        for i, row in enumerate(group):
            place[row[1]] = i + 1
            before[row[1]] = group[i - 1][3] if i else None
    assert {r["n"]: r["out"] for r in ordered.positions(df, ["k"], ["n"], "out").collect()} == place
    assert {r["n"]: r["out"] for r in ordered.previous(df, ["k"], ["n"], "s", "out").collect()} == before


def test_a_hot_key_is_spread_over_slices(skewed):
    _, df = skewed
    cut = ordered.slices(df, ["k"], ["n"])
    assert cut.filter("k = 'hot'").select(ordered.SLICE).distinct().count() > 1


@pytest.mark.parametrize("chunk", [10_000, 100, 7])
def test_nest_keeps_everything_in_order(skewed, chunk):
    data, df = skewed
    out = ordered.nest(df, ["k"], ["n"], [F.col("n"), F.col("s")], "all", chunk).collect()
    assert max(len(r["all"]) for r in out) <= max(chunk, 1)
    rebuilt = {}
    for r in sorted(out, key=lambda r: r["part"]):
        rebuilt.setdefault(r["k"], []).extend((e["n"], e["s"]) for e in r["all"])
    assert rebuilt == {k: [(n, s) for _, n, _, s in g] for k, g in by_key(data).items()}


def test_nest_parts_are_numbered_from_one(skewed):
    _, df = skewed
    out = ordered.nest(df, ["k"], ["n"], [F.col("n")], "all", 500)
    assert rows(out.filter("k = 'hot'"), "part")[0] == (1,)


def test_nest_of_small_keys_is_one_shuffle_without_slices(skewed, monkeypatch):
    data, df = skewed
    monkeypatch.setattr(ordered, "slices", None)
    out = ordered.nest(df, ["k"], ["n"], [F.col("n")], "all", 10_000)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r["k"]: [e["n"] for e in r["all"]] for r in out.collect()} == {k: [r[1] for r in g] for k, g in by_key(data).items()}


def test_nest_cuts_lists_whatever_the_counted_rows_say(skewed):
    _, df = skewed
    whole = rows(ordered.nest(df, ["k"], ["n"], [F.col("n")], "all", 100), "k", "part")
    assert rows(ordered.nest(df, ["k"], ["n"], [F.col("n")], "all", 100, counted=df.limit(0)), "k", "part") == whole
    assert rows(ordered.nest(df, ["k"], ["n"], [F.col("n")], "all", 100, counted=df.union(df)), "k", "part") == whole
