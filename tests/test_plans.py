"""What the plans must and must not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.views import Data
from tradebook import session
from tradebook.operators import documents, joins, quality, search, stock
from tradebook.plans import reports, stats
from tradebook.sources import layout

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_and_date_filters_reach_the_scan(spark):
    d = Data(spark, SF)
    text = physical(d.invoices.filter("date >= DATE '2001-01-01' AND status = 'confirmed'").select("id"))
    assert "o_orderstatus" in text.split("DataFilters")[1] and "o_totalprice" not in text


def test_page_is_a_top_k(spark):
    rows = Data(spark, SF).invoices.select("id", "created_at")
    assert "TakeOrderedAndProject(limit=50" in physical(search.page_of(rows, search.newest_first(), 1, 50))


def test_pages_near_the_front_are_a_top_k(spark):
    rows = spark.range(200_000).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    assert "TakeOrderedAndProject(limit=200, offset=100" in physical(search.page_of(rows, search.newest_first(), 2, 100))


def test_a_deep_page_writes_nothing_and_gathers_no_earlier_rows(spark, monkeypatch):
    rows = spark.range(200_000).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    deep = search.page_of(rows, search.newest_first(), 1_500, 100)
    text = physical(deep)
    assert "parquet" not in text and "rangepartitioning" not in text and "TakeOrderedAndProject(limit=" in text
    assert int(text.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= search.SHALLOW
    assert [r["id"] for r in deep.collect()] == list(range(149_900, 150_000))
    assert search.page_of(rows, search.newest_first(), 1_000_000, 100).count() == 0
    assert [r["id"] for r in search.page_of(rows, search.newest_first(), 2_000, 100).collect()] == list(range(199_900, 200_000))
    short = spark.range(150_030).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    assert [r["id"] for r in search.page_of(short, search.newest_first(), 1_501, 100).collect()] == list(range(150_000, 150_030))


def test_deep_pages_of_any_order_are_slices_of_the_sorted_list(spark, monkeypatch):
    monkeypatch.setattr(search, "SHALLOW", 20)
    monkeypatch.setattr(search, "SAMPLE", 12)
    monkeypatch.setattr(search, "BOUNDS", 3)
    rows = spark.range(400).selectExpr(
        "id", "if(id % 7 = 0, null, concat('Ž', cast(id % 5 as string))) AS name", "if(id % 11 = 0, null, make_date(2024, 1, 1 + int(id % 9))) AS day",
        "if(id % 13 = 0, null, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(id % 6))) AS moment", "cast(id % 17 as decimal(10,2)) / 3 AS price")
    for order in ([search.Sort(F.col("name")), search.Sort(F.col("id"))], [search.Sort(F.col("day"), True), search.Sort(F.col("id"))],
                  [search.Sort(F.col("moment"), True), search.Sort(F.col("name")), search.Sort(F.col("id"), True)],
                  [search.Sort(F.collate("name", "UNICODE")), search.Sort(F.col("price"), True), search.Sort(F.col("id"))]):
        want = [r["id"] for r in search.sorted_by(rows, order).collect()]
        for page in (1, 2, 3, 9, 14, 40, 41):
            assert [r["id"] for r in search.page_of(rows, order, page, 10).collect()] == want[10 * (page - 1):10 * page]


def test_details_are_sorted_where_they_are(spark):
    d = Data(spark, SF)
    for df, key, order in ((reports.invoice_detail(d), "id", ("item_created_at", "item_id")), (reports.invoice_documents(d), "id", ("part",)),
                           (reports.delivery_detail(d), "id", ("item_created_at", "item_id")), (reports.delivery_documents(d), "id", ("part",))):
        assert "rangepartitioning" not in plan(df)
        seen, last = {}, None
        for r in df.select(key, *order).collect():
            at = tuple((v is not None, v) for v in r[1:])
            assert r[0] == last or r[0] not in seen, "rows of a document are together"
            assert r[0] != last or seen[r[0]] <= at
            seen[r[0]], last = at, r[0]


def test_a_cursor_walks_through_all_rows(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 7 = 0, null, cast(id % 5 as string)) AS name")
    for descending in (False, True):
        order = [search.Sort(F.col("name"), descending), search.Sort(F.col("id"))]
        want = [r["id"] for r in search.sorted_by(rows, order).collect()]
        seen, left = [], rows
        while part := search.page_of(left, order, 1, 33).collect():
            seen += [r["id"] for r in part]
            left = search.after_key(rows, "name", part[-1]["name"], "id", part[-1]["id"], descending)
        assert seen == want


def test_list_reads_no_line_columns_but_the_header_key(spark):
    text = physical(reports.list_invoices(Data(spark, SF)))
    scans = [part.split("ReadSchema: ")[1] for part in text.split("FileScan")[1:] if "lineitem" in part]
    assert scans and all(s.startswith("struct<l_orderkey:bigint>") for s in scans)


def test_balance_needs_no_window(spark):
    d = Data(spark, SF)
    moves = d.invoices.selectExpr("id AS request_id", "id AS invoice_id", "date")
    text = plan(stock.stock_balance(moves, d.invoice_items, d.products, d.product_group_items, d.product_groups))
    assert "Window" not in text


def test_top_product_needs_no_window(spark):
    assert "Window" not in plan(stats.top_product_per_client(Data(spark, SF), "year"))


def test_no_hinted_broadcast_but_the_page(spark):
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "tradebook"
    uses = [str(p) for p in root.rglob("*.py") if "llm" not in p.parts and "broadcast(" in p.read_text()]
    assert [u for u in uses if not u.endswith("reports.py")] == []


def test_bucketed_documents_join_and_count_without_a_shuffle(spark, tmp_path):
    d = Data(spark, SF)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS books LOCATION '{tmp_path}/books'")
    layout.store_bucketed({n: d[n] for n in ("invoices", "invoice_items", "activity_logs")}, "books", 4, f"{tmp_path}/data")
    t = layout.open_bucketed(spark, "books")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    counted = joins.with_counts(t["invoices"].select("id"), t["invoice_items"], "invoice_id")
    text = physical(counted)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and counted.count() == d.invoices.count()
    assert t["activity_logs"].count() == d.activity_logs.count()


def test_shuffle_partitions_grow_with_the_input_only(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    lines = Data(spark, SF).lineitem
    assert session.size_shuffles(spark, lines) == int(before)
    assert session.size_shuffles(spark, lines, per_task=4096) > 20
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 20
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_reach_their_unknown_keys_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        keys = spark.range(20_000)
        logs = spark.createDataFrame([(1, 5), (2, -1), (3, None), (4, -1)], "id long, user_id long")
        found = quality.check_references({"activity_logs": logs, "users": keys})
        assert "SortMergeJoin" not in physical(found) and "Exchange hashpartitioning" not in physical(found)
        assert sorted(tuple(r) for r in found.collect()) == [
            ("activity_logs", "user_id_exists", "2", "-1"), ("activity_logs", "user_id_exists", "4", "-1")]
        lines = spark.createDataFrame(
            [(1, 5, "1", "2"), (2, -1, "1", "2"), (3, None, "1", "2")], "request_id long, product_id long, quantity string, unit_price string")
        facts = documents._line_facts(lines, keys, True)
        assert "SortMergeJoin" not in physical(facts)
        assert {r["request_id"]: r["_stray"] for r in facts.collect()} == {1: False, 2: True, 3: True}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_and_shuffles_are_bounded_by_task(spark):
    d = Data(spark, SF)
    assert 0 < int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= session.SPLIT
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    session.configure(spark)
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == 1 << 20
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert d.region.count() == 5
