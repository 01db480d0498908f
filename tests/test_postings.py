"""Searches through postings give the rows of the scan and read little."""

from __future__ import annotations

import random

import pytest

from tests.small import frame, rows
from tradebook.operators import postings, search
from tradebook.plans import export, reports
from tradebook.sources import layout

ALPHABET = "abAB1%_\\ \u0130\u03a3\u03c3\U0001f600"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(11)

    def text():
        return None if rng.random() < 0.1 else "".join(rng.choices(ALPHABET, k=rng.randrange(9)))

    df = spark.createDataFrame([(str(i), text(), text()) for i in range(1500)], "id string, name string, code string")
    path = str(tmp_path_factory.mktemp("postings"))
    postings.store_postings(df, ["name", "code"], path)
    return df.persist(), postings.open_postings(spark, path), path, rng


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("few", [0, 10_000])
def test_random_terms(made, monkeypatch, few):
    df, index, _, rng = made
    monkeypatch.setattr(postings, "FEW", few)
    terms = ["".join(rng.choices(ALPHABET, k=rng.randrange(3, 6))) for _ in range(8)]
    terms += ["aba", "AB%1b", "ab", "a_b", "", "zzz", "a\\%b", "bab\\", "\u03a3ab", "ab\u0130"]
    hits = 0
    for term in terms:
        want = rows(search.search_any(df, ["name", "code"], term))
        assert rows(search.search_any(df, ["name", "code"], term, index)) == want, term
        hits += len(want)
    assert hits > 1500


def test_terms_and_their_grams(spark):
    assert list(postings.stretches("%ab\\%c_d%")) == ["", "ab%c", "d", ""]
    assert postings.grams_of(spark, "%ABCa%xy%") == ["abc", "bca"]
    assert postings.grams_of(spark, "%ab_cd%") == []


def test_only_the_folders_of_few_grams_are_read(spark, made, tmp_path, monkeypatch):
    df, index, _, _ = made
    pattern = search.like_pattern("abab1")
    found, most = postings.candidates(index, ["name"], pattern)
    plan = plan_of(found)
    assert "PartitionFilters: [slot#" in plan and "In(gram" in plan
    assert postings.candidates(index, ["name"], "%ab%") is None and postings.candidates(index, ["other"], pattern) is None
    spark.sql("CREATE DATABASE IF NOT EXISTS searched")
    layout.store_bucketed({"clients": df}, "searched", 64, f"{tmp_path}/data")
    clients = layout.open_bucketed(spark, "searched")["clients"]
    monkeypatch.setattr(postings, "FEW", 10_000)
    term = next(r[0] for r in rows(df, "name") if r[0] and len(r[0]) > 4 and not set(r[0]) & set("%_\\\\"))[:4]
    few = search.search_any(clients, ["name"], term, index)
    assert rows(few) == rows(search.search_any(df, ["name"], term)) and 0 < few.count() < 20
    assert "PushedFilters: [" in plan_of(few) and ("EqualTo(id," in plan_of(few) or "In(id," in plan_of(few))
    spark.sql("DROP DATABASE searched CASCADE")


def test_no_struct_is_made_for_each_posting(spark):
    df = spark.createDataFrame([("a", "Abcab", "ab"), ("b", None, "cABc"), (None, "aaaa", None)], "id string, name string, code string")
    made = postings.postings(df, ["name", "code"])
    assert rows(made, "gram", "field", "key") == [
        ("aaa", "name", None), ("abc", "code", "b"), ("abc", "name", "a"), ("bca", "name", "a"), ("cab", "code", "b"), ("cab", "name", "a")]
    assert made.schema.simpleString() == "struct<slot:int,gram:string,field:string,key:string>"
    # One lambda for the pieces of each column, none that puts a field beside every gram.
    optimized = made._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("lambdafunction(") == 2


def test_appended_and_stale_rows(spark, tmp_path):
    path, ddl = str(tmp_path / "p"), "id long, name string"
    old = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, None), (4, "")], ddl)
    postings.store_postings(old, ["name"], path)
    now = spark.createDataFrame([(1, "gamma"), (2, "beta"), (5, "alphabet")], ddl)
    for _ in range(2):
        postings.store_postings(now.filter("id <> 2"), ["name"], path, append=True)
    index = postings.open_postings(spark, path)
    assert rows(search.search_any(now, ["name"], "ALPHA", index), "id") == [(5,)]
    assert rows(search.search_any(now, ["name"], "amm", index), "id") == [(1,)]
    assert rows(search.search_any(now, ["name"], "beta", index), "id") == [(2,)]
    none = str(tmp_path / "none")
    postings.store_postings(old.limit(0), ["name"], none)
    assert rows(search.search_any(old.limit(0), ["name"], "beta", postings.open_postings(spark, none))) == []


def test_one_partition_of_rows_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PER_TASK", 50)
    df = spark.createDataFrame([(i, f"same{i:04d}") for i in range(400)] + [(None, "same"), (7, None)], "id long, name string")
    path = str(tmp_path / "p")
    postings.store_postings(df.coalesce(1), ["name"], path)
    index = postings.open_postings(spark, path)
    assert index.rows.filter("gram = 'sam'").select("_metadata.file_path").distinct().count() > 4
    assert rows(index.counts.filter("gram IN ('sam', 'e03')"), "gram", "n") == [("e03", 100), ("sam", 401)]
    assert rows(search.search_any(df, ["name"], "same039", index)) == rows(search.search_any(df, ["name"], "same039"))


@pytest.mark.parametrize("few", [0, 1_000])
def test_documents_by_number_or_client(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(reports, "FEW", few)
    monkeypatch.setattr(postings, "FEW", few)
    clients = frame(spark, "clients", [{"id": f"c{i}", "name": f"Firm {i:03d} doo"} for i in range(40)])
    heads = frame(spark, "invoices", [
        {"id": f"v{i}", "number": f"INV-{i:04d}", "client_id": f"c{i % 40}", "status": "draft"} for i in range(300)])
    index = {}
    for name, df in (("invoices", heads), ("clients", clients)):
        postings.store_postings(df, reports.SEARCHED[name], str(tmp_path / name))
        index[name] = postings.open_postings(spark, str(tmp_path / name))
    for term, n in (("m 007", 8), ("v-0007", 1), ("007", 18), ("07", 36), ("nope", 0)):
        got = reports.documents_found(heads, clients, term, "draft", None, index["invoices"], index["clients"])
        assert rows(got) == rows(reports.documents_found(heads, clients, term, "draft"))
        assert term == "07" or got.count() == n
    t = {"clients": clients}
    assert rows(export.export_clients(t, "FIRM 01", index)) == rows(export.export_clients(t, "FIRM 01"))
    assert rows(reports.list_clients(t, "rm 01", indexes=index)) == rows(reports.list_clients(t, "rm 01"))
