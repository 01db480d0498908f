"""A small batch against a large table: few rows are shuffled, and the answer is that of the plain join."""

from __future__ import annotations

import pytest

from tests.small import rows
from tradebook.operators import bloom, merge


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("base") / "t")
    spark.range(50_000).selectExpr("id", "IF(id % 10 = 0, NULL, concat('k', id)) AS mb", "id * 2 AS pib").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def requests(spark):
    data = [(i, f"k{i * 700 + 1}" if i % 3 else None, i * 700 + (i % 5 == 0), i * 700 + 1) for i in range(100)]
    return spark.createDataFrame(data, "request_id long, mb string, pib long, own long")


def test_few_rows_pass_and_all_that_meet(spark, base, requests, monkeypatch):
    keys = requests.select("mb")
    test = bloom.may_hold(keys, "mb")
    met = base.join(keys, "mb", "left_semi")
    assert rows(base.filter(test).join(keys, "mb", "left_semi")) == rows(met) and met.count() > 20
    assert base.filter(test).count() < met.count() + 50_000 // 20
    monkeypatch.setattr(bloom, "LARGE", 0)
    text = bloom.narrowed(base, "mb", keys)._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in text and "split(" not in text and "Exchange" not in text  # a constant, on the scan
    assert bloom.may_hold(keys.limit(0), "mb") is not None and base.filter(bloom.may_hold(keys.limit(0), "mb")).count() == 0
    monkeypatch.setattr(bloom, "MOST", 10)
    assert bloom.may_hold(keys, "mb") is None and bloom.narrowed(base, "mb", keys) is base


@pytest.mark.parametrize("own", [None, "own"])
def test_taken_with_and_without_the_filter(base, requests, monkeypatch, own):
    want = rows(merge.taken(requests, base, ["mb", "pib"], own))
    monkeypatch.setattr(bloom, "LARGE", 0)
    found = merge.taken(requests, base, ["mb", "pib"], own)
    assert "getbit" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == want and len(want) > 10


def test_other_kinds_are_joined_as_they_are(spark, base, monkeypatch):
    monkeypatch.setattr(bloom, "LARGE", 0)
    asked = spark.createDataFrame([(1, "0014")], "request_id long, pib string")
    assert bloom.narrowed(base, "pib", asked.select("pib")) is base
    assert rows(merge.taken(asked, base, ["pib"])) == [(1,)]
