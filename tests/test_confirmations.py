"""The stock stream: requests delivered again, and the runs of its ledger."""

from __future__ import annotations

import datetime as dt
import pathlib
import random
from decimal import Decimal

from small import frame, rows, seed

from tradebook.streaming import activity, confirmations, runs

DDL = "request_id string, id string, status string"


def tables(spark, invoices=6):
    t = seed(spark)
    t["invoices"] = frame(spark, "invoices", [
        {"id": f"v{i}", "status": "confirmed" if i == 3 else "draft", "date": dt.date(2024, 1, 1)} for i in range(1, invoices)])
    t["invoice_items"] = frame(spark, "invoice_items", [
        {"id": f"i{i}", "invoice_id": f"v{i}", "product_id": "p1", "quantity": i} for i in range(1, invoices)])
    return t


def loop(batches, invoices=6, open_quantity=9000, weight=500):
    """One request at a time; the quantity after each batch."""
    status = {f"v{i}": "confirmed" if i == 3 else "draft" for i in range(1, invoices)}
    done, left, out = set(), open_quantity, []
    for batch in batches:
        for request, invoice, wanted in sorted(set(batch)):
            if invoice in status and request not in done and wanted in ("draft", "confirmed"):
                done.add(request)
                if wanted == "confirmed" and status[invoice] != "confirmed":
                    left = max(0, left - weight * int(invoice[1:]))
                status[invoice] = wanted
        out.append(Decimal(left).quantize(Decimal("0.01")))
    return out


def quantity(spark, state, version):
    return rows(confirmations.balances(spark, state, version), "current_quantity")[0][0]


def test_a_request_delivered_again_after_a_reopening_changes_nothing(spark, tmp_path):
    batches = [[("r1", "v1", "confirmed"), ("r2", "v9", "confirmed")], [("r3", "v1", "draft")], [("r1", "v1", "confirmed")],
               [("r4", "v1", "confirmed"), ("r3", "v1", "draft"), ("r2", "v9", "confirmed")], [("r5", "v2", "odd"), ("r5", "v2", "confirmed")]]
    for part in batches:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = activity.file_stream(spark, str(tmp_path / "src"), spark.createDataFrame([], DDL).schema, files_per_trigger=1)
    state = str(tmp_path / "state")
    confirmations.stock_stream(stream, tables(spark), state, str(tmp_path / "cp")).awaitTermination()
    want = loop(batches)
    assert want == [Decimal("8500.00")] * 3 + [Decimal("8000.00"), Decimal("7000.00")]
    assert [quantity(spark, state, v) for v in range(5)] == want


def test_batches_equal_the_loop_and_may_run_twice(spark, tmp_path):
    rng, state, t = random.Random(5), str(tmp_path / "state"), tables(spark)
    pool = [(f"r{i:02d}", f"v{rng.randrange(1, 7)}", rng.choice(["draft", "confirmed"])) for i in range(14)]
    batches = [rng.sample(pool, 4) for _ in range(7)] + [[]]
    want = loop(batches)
    for version, part in enumerate(batches):
        for _ in range(1 + version % 2):
            confirmations.apply_batch(spark.createDataFrame(part, DDL), version, t, state)
        assert quantity(spark, state, version) == want[version]
        kept = {p.name for p in pathlib.Path(state, "ledger").iterdir()}
        assert kept >= {f"{a}-{z}" for a, z in runs.runs(version + 1)}
        assert len(kept) <= 2 * (version + 1).bit_length()
    merged = confirmations.read_ledger(spark, state, runs.runs(8))
    assert runs.runs(8) == [(0, 8)] and merged.groupBy("kind", "key").count().filter("count > 1").count() == 0


def test_runs_are_the_digits_of_the_version():
    for version in range(200):
        held = runs.runs(version)
        assert [v for a, z in held for v in range(a, z)] == list(range(version))
        assert len(held) == version.bit_count()
        run = runs.written_run(version)
        assert runs.runs(version + 1) == [r for r in held if r[0] < run[0]] + [run]


def test_the_ledger_and_the_invoices_are_read_by_range(spark, tmp_path):
    state = str(tmp_path / "state")
    t = tables(spark)
    t["invoices"].write.parquet(str(tmp_path / "invoices"))
    t["invoices"] = spark.read.parquet(str(tmp_path / "invoices"))
    confirmations.apply_batch(spark.createDataFrame([("r1", "v2", "confirmed")], DDL), 0, t, state)
    ids = spark.createDataFrame([("v2",), ("v4",)], "id string")
    found = confirmations._current(t, ids, state, 1)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(id,v2), LessThanOrEqual(id,v4)" in plan and "GreaterThanOrEqual(key,v2), LessThanOrEqual(key,v4)" in plan
    assert rows(found, "id", "status") == [("v2", "confirmed"), ("v4", "draft")]
