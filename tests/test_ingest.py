"""CSV cells, dedupe and the zip table on hand-made rows."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.audits import join_rows, orphans
from tallyhouse.operators.picking import capped, first_per_key, most_frequent
from tallyhouse.sources import csv_records, ledger
from tallyhouse.sources.csv_files import lenient_int, load_table, read_table, scan_csv, write_csv
from tallyhouse.sources.sinks import write_results_csv, write_runs
from tallyhouse.sources.tables import full_refresh, stored


def test_reviews_with_mark_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_bytes(
        b"\xef\xbb\xbfreview_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date\n"
        b'r1,o1,5,,"first line\nsecond ""quoted"", line",2018-01-02 03:04:05\n'
        b"r2,o2,x,title,,2018-01-03\n"
        b"r3,o3,4.0,,plain,31/12/2018\n"
    )
    rows = {r.review_id: r for r in read_table(spark, str(path), "order_reviews").collect()}
    assert rows["r1"].review_comment_message == 'first line\nsecond "quoted", line'
    assert rows["r1"].review_comment_title is None
    assert rows["r1"].review_creation_date == datetime.datetime(2018, 1, 2, 3, 4, 5)
    assert (rows["r2"].review_score, rows["r3"].review_score) == (None, 4)
    assert rows["r2"].review_creation_date == datetime.datetime(2018, 1, 3)
    assert rows["r3"].review_creation_date is None


def test_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("freight_value,order_id,unknown,order_item_id,price\n1.239,o1,zz,-2.9,10\nbad,o2,zz,,\n")
    rows = read_table(spark, str(path), "order_items").orderBy("order_id").collect()
    assert rows[0].asDict() == {
        "freight_value": Decimal("1.24"), "order_id": "o1", "order_item_id": -2,
        "price": Decimal("10.00"),
    }
    assert rows[1].freight_value is None and rows[1].order_item_id is None and rows[1].price is None
    assert "unknown" in scan_csv(spark, str(path)).columns


def test_first_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, at int, v string")
    kept = first_per_key(rows, ["k"], [F.asc("at")]).orderBy("k").collect()
    assert [(r.k, r.v) for r in kept] == [("a", "early"), ("b", "only")]


def test_most_frequent_takes_the_smallest_on_a_tie(spark):
    rows = spark.createDataFrame(
        [("z1", "b"), ("z1", "a"), ("z1", "b"), ("z1", "a"), ("z2", None), ("z2", "c"), ("z3", None)], "zip string, city string"
    )
    got = {r.zip: r.city for r in most_frequent(rows, ["zip"], "city").collect()}
    assert got == {"z1": "a", "z2": "c"}


def test_cap_tells_whether_rows_were_left_out(spark):
    rows = spark.range(5)
    assert [(r.id, r.truncated) for r in capped(rows, 3, F.asc("id")).collect()] == [(0, 1), (1, 1), (2, 1)]
    assert [r.truncated for r in capped(rows, 5, F.asc("id")).collect()] == [0] * 5


def test_orphans_ignore_missing_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,)], "k int")
    other = spark.createDataFrame([("1", 2), ("3", 2), ("3", 9)], "k string, id int")
    tables = {"child": child, "parent": parent, "other": other, "none": child.limit(0)}
    relations = [("child", "k", "parent", "k"), ("other", "k", "parent", "k"), ("parent", "k", "other", "id"), ("none", "k", "parent", "k")]
    found = {r.relationship: (r.n_rows, r.n_orphans) for r in orphans(tables, relations[:3]).collect()}
    assert found == {"child.k": (4, 1), "other.k": (3, 2), "parent.k": (2, 2)}
    assert tuple(orphans(tables, relations[3:]).first()) == ("none.k", 0, 0)
    assert join_rows(child, "k", parent, "k", "n").first().n == 4


def test_full_refresh_replaces_everything(spark, tmp_path):
    path = str(tmp_path / "table")
    full_refresh(spark.range(10), path)
    assert sorted(r.id for r in full_refresh(spark.range(2), path).collect()) == [0, 1]


def test_a_batch_counts_once_however_often_it_is_appended(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(f"e{i}", i % 2, "pass") for i in range(6)], "query_id string, ex int, status string")
    ledger.append(rows, path, "first")
    ledger.append(rows, path, "first")
    # Cut off before its manifest was written.
    ledger.write_attempt(rows, path, "second")
    assert ledger.read_batches(spark, path).count() == 6
    ledger.append(rows.limit(2), path, "second")
    assert ledger.read_batches(spark, path).count() == 8
    assert spark.read.schema(ledger.MANIFEST).json(f"{path}/manifest").count() == 3
    with pytest.raises(ValueError):
        ledger.append(rows, path, "no/such")


def test_ledger_survives_broken_lines(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    path.write_text(
        '{"query_id": "e01", "ex": 1, "status": "pass"}\n'
        "\n"
        '{"ex": 0, "status": "fail"}\n'
        '{"query_id": "", "ex": 0}\n'
        '{"query_id": "e02", "ex": "not a number", "status": "fail"}\n'
        '{"query_id": "e03", "sta'
    )
    rows = {r.query_id: (r.ex, r.status) for r in ledger.read(spark, str(path)).collect()}
    assert rows == {"e01": (1, "pass"), "e02": (None, "fail")}


CELLS = ["  two blanks both ends  ", "\nline break first\n", 'say "so", twice', "a\nb", "\ttab", "plain"]


def test_cells_come_back_unchanged(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(CELLS)], "customer_id string, customer_city string")
    back = scan_csv(spark, write_csv(rows, str(tmp_path / "csv"))).collect()
    assert {int(r.customer_id): r.customer_city for r in back} == dict(enumerate(CELLS))
    results = rows.select(F.col("customer_id").alias("query_id"), F.col("customer_city").alias("predicted_sql"))
    back = scan_csv(spark, write_results_csv(results, str(tmp_path / "results"))).collect()
    assert {int(r.query_id): r.predicted_sql for r in back} == dict(enumerate(CELLS))


def test_line_breaks_in_any_table(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text('seller_id,seller_city\n3,"a\nb"\n4,c\n')
    rows = read_table(spark, str(path), "sellers").collect()
    assert {r.seller_id: r.seller_city for r in rows} == {"3": "a\nb", "4": "c"}


def test_numbers_without_type_suffix(spark):
    cells = ["12d", "5f", "7D", "1e1", "1_000", "1__0", " 12.9 ", "-.5", "5.", "NaN", "inf", "0x1", "", None, "99999999999"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in frame.select(lenient_int(F.col("c"))).collect()]
    assert got == [None, None, None, 10, 1000, None, 12, 0, 5, None, None, None, None, None, None]


def test_load_keeps_the_first_row_of_a_key(spark, tmp_path):
    for name, rows in (("b.csv", "s1,late\ns3,new\n"), ("a.csv", "s1,first\ns2,x\ns1,second\n")):
        (tmp_path / name).write_text("seller_id,seller_city\n" + rows)
    for _ in range(2):
        table = load_table(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], "sellers", str(tmp_path / "stored"))
        assert {r.seller_id: r.seller_city for r in table.collect()} == {"s1": "first", "s2": "x", "s3": "new"}
    assert spark.read.parquet(str(tmp_path / "stored")).count() == 3


@pytest.mark.parametrize("cases", [0, 10, 10_000])
def test_a_run_has_one_layout_at_every_size(spark, tmp_path, cases):
    results = spark.range(cases).select(
        F.col("id").alias("query_id"), F.lit(1).alias("run_no"), F.lit(0).alias("em"), F.lit(1).alias("ex"),
        F.when(F.col("id") % 3 == 0, "pass").otherwise("fail").alias("status"),
        *[F.lit("NA").alias(d) for d in ("table", "time_frame", "filters", "aggregation", "join")],
    )
    runs = spark.createDataFrame([(1, "r_1", "R 1", "full", cases, 0.5)], "run_no int, run_id string, name string, mode string, total int, pass_rate double")
    path = write_runs(results, runs, str(tmp_path / "runs"))
    passes = len(range(0, cases, 3))
    header = spark.read.json(f"{path}/runs").collect()
    assert len(header) == 1 and (header[0].run_id, header[0].name, header[0].totals.pass_rate) == ("r_1", "R 1", 0.5)
    assert (header[0].n_passes, header[0].n_failures) == (passes, cases - passes)
    stored = spark.read.schema("query_id bigint, run_no int, part string").json(f"{path}/cases")
    assert sorted(r.query_id for r in stored.collect()) == list(range(cases))
    assert stored.where("part = 'passes'").count() == passes


def test_files_of_runs_are_bounded_in_number_and_size(spark, tmp_path):
    grades = [F.lit("NA").alias(d) for d in ("table", "time_frame", "filters", "aggregation", "join")]
    small = spark.range(400).select(F.col("id").alias("run_no"), F.col("id").alias("query_id"))
    huge = spark.range(1000, 9000).select(F.lit(1000).cast("long").alias("run_no"), F.col("id").alias("query_id"))
    results = small.union(huge).select("*", F.lit("pass").alias("status"), *grades)
    runs = results.select("run_no").distinct().selectExpr("run_no", "'r' as run_id", "'r' as name", "'full' as mode", "1 as total")
    path = write_runs(results, runs, str(tmp_path / "runs"), file_chars=100_000)
    sizes = [f.stat().st_size for f in (tmp_path / "runs" / "cases").rglob("*.json")]
    assert sum(sizes) > 1_000_000 and max(sizes) < 200_000 and len(sizes) <= sum(sizes) / 50_000
    files = spark.read.parquet(f"{path}/files").where("run_no = 1000").first()
    assert files.last_file > files.first_file
    cases = spark.read.schema("query_id bigint, run_no bigint, file int").json(f"{path}/cases")
    assert cases.count() == 8400
    held = cases.where(F.col("run_no") == 1000).agg(F.min("file"), F.max("file")).first()
    assert tuple(held) == (files.first_file, files.last_file)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tallyhouse.session import scratch_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:7077"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session("local-cluster[2,1,1024]"), "x")
    assert scratch_dir(session("yarn", "hdfs:///s/"), "x").startswith("hdfs:///s/tallyhouse/x-")
    assert scratch_dir(session("local[4]"), "x")


def builtin_csv(spark, path):
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1).csv(path)


CSV_TEXTS = {
    "spanning": 'a,b,c\n1,"x\ny",2\n3,"""quoted"", and\n\n,more",4\n5,,""\n"6","\n\n\n","7\n"\n8,9\n10,11,12,13\n',
    "quotes inside plain cells": 'a,b\n5" pipe,x\n6"",y"\n"5"" pipe",""""\n"a"b"c,d\n7,"e\nf" tail,g\n',
    "carriage returns": 'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n',
    "no line spans": 'a,b\n1,"x, y"\n2,"""z"""\n\n3,\n',
    "never closed": 'a,b\n1,"x\ny\nz,2\n3,4',
    "header spans": '"a\nb","c"\n1,"2\n3"\n',
    "header only": "a,b\n",
}


@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_files_are_read_in_ranges_as_they_are_read_whole(spark, tmp_path, width):
    rng = random.Random(3)
    cells = ["", "x", "a b", '"', '""', ",", "\n", '\n"\n', "line\nbreak", '",\n', "ü", "long " * 9]
    rows = [[rng.choice(cells) + rng.choice(cells) for _ in range(3)] for _ in range(60)]
    many = "a,b,c\n" + "".join(",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n" for row in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i, (name, text) in enumerate({**CSV_TEXTS, "many": many}.items()):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(b"\xef\xbb\xbf" * (i % 2) + text.encode())
        want = builtin_csv(spark, str(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        try:
            got = scan_csv(spark, str(path), ["_range", "_line"])
            assert got.columns[:-2] == want.columns, name
            found = [tuple(r[:-2]) for r in got.orderBy("_range", "_line").collect()]
            tasks = got.select("_range").distinct().count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert found == [tuple(r) for r in want.collect()], name
        if name == "many":
            assert tasks > 1 or width > len(text)


def test_files_without_open_cells_need_no_exchange(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text('a,b\n1,"x, y"\n2,z\n')
    plan = scan_csv(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_lines_of_files_with_open_cells_are_exchanged_once(spark, tmp_path, monkeypatch):
    for name in ("b", "a"):
        (tmp_path / f"{name}.csv").write_text(f'k,v\n{name}1,"x\ny"\n{name}2,z\n')
    plans = {}

    def kept(rows, purpose):
        plans[purpose] = rows._jdf.queryExecution().executedPlan().toString()
        return stored(rows, purpose)

    monkeypatch.setattr(csv_records, "stored", kept)
    read = scan_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], ["_file"])
    plans["records"] = read._jdf.queryExecution().executedPlan().toString()
    assert {p for p, text in plans.items() if "FileScan text" in text} == {"csv-files", "csv-lines"}
    assert sorted(map(tuple, read.collect())) == [("a1", "x\ny", 1), ("a2", "z", 1), ("b1", "x\ny", 2), ("b2", "z", 2)]
