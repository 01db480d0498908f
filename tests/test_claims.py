"""Keys claimed and released in a batch against a loop that takes the requests one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from small import frame, rows, seed

from tradebook.operators import claims, merge, registers

NOW = dt.datetime(2024, 3, 1, 12)


def loop(requests, base, sparse=False):
    """Refused request ids."""
    own, refused = {i: list(keys) for i, *keys in base}, []
    for r, i, real, *keys in sorted(requests):
        if any(k is not None and any(j != i and other[n] == k for j, other in own.items()) for n, k in enumerate(keys)):
            refused.append(r)
        elif real:
            before = own.get(i, [None] * len(keys))
            own[i] = [b if k is None and sparse else k for k, b in zip(keys, before)]
    return refused


def refused(spark, requests, base, sparse=False):
    df = spark.createDataFrame(requests, "request_id int, id string, real boolean, a string, b string").repartition(5)
    held = spark.createDataFrame(base, "id string, a string, b string")
    return sorted(r[0] for r in claims.clashes(df, held, ["a", "b"], sparse).collect())


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("wide", [6, 14, 40])
def test_clashes_equal_the_loop(spark, sparse, wide):
    rng = random.Random(wide)
    base = [(f"x{i}", f"a{i}", f"b{i}" if i % 4 else None) for i in range(10)]
    asked = []
    for r in range(90):
        row = f"x{rng.randrange(14)}"
        asked.append((r, row, int(row[1:]) < 10, rng.choice([None, *(f"a{i}" for i in range(wide))]), rng.choice([None, *(f"b{i}" for i in range(wide))])))
    assert refused(spark, asked, base, sparse) == loop(asked, base, sparse)


def test_keys_change_hands(spark):
    base = [("x", "1", None), ("y", "2", None), ("z", "3", None)]
    swap = [(1, "x", True, "9", None), (2, "y", True, "1", None), (3, "x", True, "2", None), (4, "z", True, "1", None), (5, "y", True, "3", None),
            (6, "z", True, "4", None), (7, "y", True, "3", None), (8, "n", False, "3", None), (9, "n", False, "1", None), (10, "x", True, "1", None)]
    assert loop(swap, base) == [4, 5, 8]
    assert refused(spark, swap, base) == [4, 5, 8]
    assert refused(spark, [], base) == [] and refused(spark, swap[:1], base) == []


def test_a_long_chain_takes_a_bounded_number_of_jobs(spark):
    """Every request shares one key with the one before and the other with the one after."""
    n = 1000
    chain = [(i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(n)]
    df = spark.createDataFrame(chain, "request_id int, a string, b string").repartition(4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = sorted(r[0] for r in merge.first_come(df, ["a", "b"]).collect())
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == list(range(0, n, 2)) and jobs < 250


def test_a_key_that_most_of_the_batch_wants(spark):
    asked = [(i, f"x{i}", True, "hot", f"b{i}") for i in range(2, 400)] + [(1, "x1", True, "hot", "held"), (500, "x0", True, "a", "hot")]
    base = [("x0", "a", "held")]
    assert refused(spark, asked, base) == loop(asked, base) == [1, *range(3, 400)]


CLIENT = "request_id string, id string, name string, legal_name string, mb string, pib string, address string, email string"


def test_clients_swap_their_keys(spark):
    t = seed(spark)
    t["clients"] = frame(spark, "clients", [
        {"id": "c1", "name": "One", "legal_name": "O", "mb": "11", "pib": "12", "address": "a"},
        {"id": "c2", "name": "Two", "legal_name": "T", "mb": "21", "pib": "22", "address": "a"}])
    asked = spark.createDataFrame([
        ("r1", "c1", "Early", "O", "21", "12", "a", None), ("r2", "c1", "Away", "O", "91", "12", "a", None), ("r3", "c2", "Two", "T", "11", "22", "a", None),
        ("r4", "c1", "Swapped", "O", "21", "12", "a", None), ("r5", "c9", "Gone", "G", "11", "5", "a", None), ("r6", "c9", "Gone", "G", "4", "5", "a", None)], CLIENT)
    made = registers.update_clients(t, asked, NOW)
    assert rows(made.rejected, "request_id", "reason") == [("r1", "duplicate"), ("r5", "duplicate"), ("r6", "not_found")]
    assert rows(made.tables["clients"], "id", "name", "mb", "pib") == [("c1", "Swapped", "21", "12"), ("c2", "Two", "11", "22")]
    assert rows(made.activity, "request_id") == [("r2",), ("r3",), ("r4",)]


def test_products_are_updated_in_turn(spark):
    t = seed(spark)
    asked = spark.createDataFrame([
        ("r1", "p1", "NEW", "n", "1", "7", None), ("r2", "p2", "PROD001", "n", "2", None, "false"), ("r3", "p1", "PROD001", "n", "3", None, None),
        ("r4", "p1", "LAST", "n", "4", None, None)], "request_id string, id string, code string, name string, price string, weight string, is_active string")
    made = registers.update_products(t, asked, NOW)
    assert rows(made.rejected, "request_id", "reason") == [("r3", "duplicate_code")]
    got = rows(made.tables["products"].selectExpr("id", "code", "cast(price as int) price", "cast(weight as int) weight", "is_active"))
    assert got == [("p1", "LAST", 4, 7, True), ("p2", "PROD001", 2, 750, False), ("p3", "PROD003", 200, 1000, True)]


def test_an_address_given_up_is_free(spark):
    t = seed(spark)
    t["users"] = frame(spark, "users", [{"id": f"u{i}", "username": f"n{i}", "email": f"e{i}@x.co", "is_active": True} for i in (1, 2, 3)])
    asked = spark.createDataFrame([("r1", "u1", "e2@x.co"), ("r2", "u2", "new@x.co"), ("r3", "u3", "e2@x.co"), ("r4", "u1", "e3@x.co"), ("r5", "u2", None)],
                                  "request_id string, id string, email string")
    made = registers.patch_users(t, asked, NOW)
    assert rows(made.rejected, "request_id", "reason") == [("r1", "duplicate"), ("r5", "no_fields")]
    assert rows(made.tables["users"], "id", "email") == [("u1", "e3@x.co"), ("u2", "new@x.co"), ("u3", "e2@x.co")]
