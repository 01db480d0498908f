"""Sinks, snapshots and streams."""

from __future__ import annotations

import datetime as dt
import functools
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.small import NOW, frame, rows, seed
from tradebook import session
from tradebook.operators.stock import stock_balance
from tradebook.sources import model, snapshots, writers
from tradebook.streaming import activity, confirmations, runs


def test_csv_keeps_commas_quotes_newlines_zero_and_false(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", all', Decimal("0.00"), False), (2, "two\nlines", None, True), (3, None, Decimal("1.50"), None), (4, " padded ", None, None)],
        "id int, note string, amount decimal(12,2), flag boolean")
    writers.write_csv(df.coalesce(1), str(tmp_path / "c"), {"id": "Id", "note": "The Note", "amount": "Amount", "flag": "Flag"})
    text = next((tmp_path / "c").glob("part-*")).read_text()
    assert text.splitlines()[0] == "Id,The Note,Amount,Flag"
    assert '1,"say ""hi"", all",0.00,false' in text
    back = writers.read_csv(spark, str(tmp_path / "c"), "id int, note string, amount decimal(12,2), flag boolean")
    assert rows(back) == rows(df)


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, note string")
    writers.write_json(df.coalesce(1), str(tmp_path / "j"))
    assert next((tmp_path / "j").glob("part-*")).read_text().splitlines()[0] == '{"id":1,"note":null}'


def test_snapshot_loads_back(spark, tmp_path):
    t = seed(spark)
    folder = snapshots.snapshot_tables(t, str(tmp_path), NOW)
    assert folder.endswith("ts=20240301_120000")
    back = model.load_tables(spark, folder)
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in t.items()}
    assert rows(back["products"], "code", "price") == rows(t["products"], "code", "price")


def test_retention_counts_whole_days(spark):
    made = spark.createDataFrame([(str(d), NOW - dt.timedelta(days=d, hours=h)) for d, h in ((1, 0), (30, 23), (31, 0), (40, 0))],
                                 "snapshot string, taken_at timestamp_ntz")
    got = snapshots.expired_snapshots(made, NOW)
    assert rows(got, "snapshot", "expired", "remaining") == [("1", False, 2), ("30", False, 2), ("31", True, 2), ("40", True, 2)]


def test_without_a_setting_the_warehouse_is_shared():
    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://store/warehouse"}.get(name, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Spark:
        conf, sparkContext = Conf(), Context()

    assert session.shared_folder(Spark()) == "hdfs://store/warehouse"


def test_a_local_warehouse_is_not_shared_on_a_cluster():
    class Conf(dict):
        get = dict.get

    class Context:
        def getCheckpointDir(self):
            return None

    class Spark:
        conf, sparkContext = Conf({"spark.sql.warehouse.dir": "file:/home/warehouse", "spark.master": "yarn"}), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Spark())
    Spark.conf["spark.master"] = "local[4]"
    assert session.shared_folder(Spark()) == "file:/home/warehouse"


def test_a_scope_removes_its_folders(spark):
    shared = pathlib.Path(session.shared_folder(spark))
    before = set(shared.iterdir())
    with session.scratch_scope():
        assert session.pinned(spark.range(3)).count() == 3
        assert set(shared.iterdir()) - before
    assert set(shared.iterdir()) == before


def test_the_shared_folder_is_the_configured_one(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.fixture
def log_files(spark, tmp_path):
    """One file per day, then a repeated file, then a very old row."""
    start = dt.datetime(2024, 1, 1)
    data = [(str(i), f"u{i % 3}" if i % 4 else None, "x", ["invoice", "client"][i % 2], f"10.0.0.{i % 2}", start + dt.timedelta(hours=5 * i))
            for i in range(60)]
    ddl = "id string, user_id string, action string, entity_type string, ip_address string, created_at timestamp_ntz"
    for n in range(6):
        spark.createDataFrame(data[n * 10:(n + 1) * 10], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    spark.createDataFrame(data[50:], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    late = [("old", "u1", "x", "invoice", "10.0.0.1", dt.datetime(2023, 1, 1))]
    spark.createDataFrame(late, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    return str(tmp_path / "src"), spark.createDataFrame(data + late, ddl)


@pytest.mark.parametrize("kind", ["windows", "rate"])
def test_stream_equals_batch_over_all_windows(spark, tmp_path, log_files, kind):
    folder, batch = log_files
    stream = activity.file_stream(spark, folder, batch.schema, files_per_trigger=1)
    log, out, checkpoint = (str(tmp_path / part) for part in ("log", "out", "cp"))
    if kind == "windows":
        activity.windows_stream(stream, log, out, checkpoint, "7 hours").awaitTermination()
        want = activity.activity_windows(batch, "7 hours")
        assert rows(spark.read.parquet(log), "id") == rows(batch, "id")
    else:  # requests are counted as they come, the repeated file too
        activity.rate_stream(stream, out, checkpoint, window="12 hours").awaitTermination()
        given = batch.unionByName(batch.filter("id <> 'old' AND cast(id AS int) >= 50"))
        want = activity.request_rate(given, window="12 hours", limit=1)
    got = activity.kept_counts(spark, out, want.schema).filter(F.col(want.columns[-1]) > int(kind == "rate"))
    assert rows(got) == rows(want) and want.count() > 3


def test_late_rows_of_many_days_are_added_to_the_partial_counts(spark, tmp_path):
    """A row in each of 1,000 days, batch by batch: only the runs of the carry are read, and the sums are those of all rows."""
    days, out = 1_000, str(tmp_path / "out")
    parts = [spark.range(days).select(
        F.concat(F.lit(f"{n}-"), "id").alias("id"), (F.col("id") % (2 + n)).cast("string").alias("ip_address"),
        F.expr(f"timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, int(id), {n}, 0, 0)").alias("created_at")) for n in range(5)]
    for version, part in enumerate(parts):
        for _ in range(1 + version % 2):  # a batch run again changes nothing
            counts = activity.request_rate(part, window="1 day", limit=0)
            read = {pathlib.Path(f).parent.name for f in activity.merged_counts(counts, version, out).inputFiles()}
            assert read == {f"{a}-{z}" for a, z in runs.carried(version)}
            activity.add_counts(counts, version, out)
    every = functools.reduce(DataFrame.unionByName, parts)
    want = activity.request_rate(every, window="1 day", limit=0)
    assert rows(activity.kept_counts(spark, out, want.schema)) == rows(want)
    assert runs.newest(spark, out) == [(0, 4), (4, 5)] and runs.newest(spark, str(tmp_path / "none")) == []
    assert activity.kept_counts(spark, str(tmp_path / "none"), want.schema).count() == 0


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    row = spark.createDataFrame([("a", NOW)], "ip_address string, created_at timestamp_ntz")
    counts = activity.request_rate(row, limit=0)
    for version in range(2):
        activity.add_counts(counts, version, out)
    (tmp_path / "out" / "2-3").mkdir()  # begun, no _SUCCESS
    assert rows(activity.kept_counts(spark, out, counts.schema), "requests") == [(2,)]
    activity.add_counts(counts, 2, out)
    assert rows(activity.kept_counts(spark, out, counts.schema), "requests") == [(3,)]


def test_log_sink_drops_repeated_rows_and_keeps_late_ones(spark, tmp_path, log_files):
    folder, batch = log_files
    stream = activity.file_stream(spark, folder, batch.schema, files_per_trigger=2)
    activity.activity_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "log"))
    assert rows(kept, "id") == rows(batch, "id")
    assert kept.select("day").distinct().count() == 14


def test_a_log_batch_run_again_changes_nothing(spark, tmp_path, log_files):
    _, batch = log_files
    path = str(tmp_path / "log")
    for version, part in enumerate(("id < '3'", "id < '5'", "id < '5'", "true")):
        for _ in range(2):
            activity.store_batch(batch.filter(part), version, path)
    assert rows(spark.read.parquet(path), "id") == rows(batch, "id")


def test_stock_stream_over_many_batches_and_a_repeated_one(spark, tmp_path):
    t = seed(spark)
    t["invoices"] = frame(spark, "invoices", [
        {"id": f"v{i}", "status": "confirmed" if i == 3 else "draft", "date": dt.date(2024, 1, i)} for i in range(1, 6)])
    t["invoice_items"] = frame(spark, "invoice_items", [
        {"id": f"i{i}", "invoice_id": f"v{i}", "product_id": "p1", "quantity": 1} for i in range(1, 6)])
    ddl = "request_id string, id string, status string"
    asked = [[("r1", "v1", "confirmed"), ("r2", "v3", "confirmed")], [("r3", "v1", "confirmed"), ("r4", "v2", "confirmed"), ("r5", "v9", "confirmed")],
             [("r6", "v1", "draft"), ("r7", "v1", "confirmed")], [("r8", "v3", "draft")], [("r9", "v3", "confirmed"), ("r9", "v3", "confirmed")]]
    for part in asked:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = activity.file_stream(spark, str(tmp_path / "src"), spark.createDataFrame([], ddl).schema, files_per_trigger=1)
    state = str(tmp_path / "state")
    confirmations.stock_stream(stream, t, state, str(tmp_path / "cp")).awaitTermination()
    assert rows(confirmations.balances(spark, state, 4), "current_quantity") == [(Decimal("7000.00"),)]
    last = spark.createDataFrame(asked[4], ddl)
    confirmations.apply_batch(last, 4, t, state)  # a batch run again changes nothing
    assert rows(confirmations.balances(spark, state, 4), "current_quantity") == [(Decimal("7000.00"),)]
    first = spark.createDataFrame([("r1", "v1", dt.date(2024, 1, 1))], "request_id string, invoice_id string, date date")
    stores = (t["invoice_items"], t["products"], t["product_group_items"], t["product_groups"])
    assert rows(stock_balance(first, *stores), "current_quantity") == rows(confirmations.balances(spark, state, 0), "current_quantity")
