"""Fallback reading: sources in order, torn and unreadable files, records without a key, counts a file."""

import json
import os

import pytest

from jobsift.operators import joins as J
from jobsift.session import work_path
from jobsift.sources import fallback as FB
from jobsift.sources import readers as RD
from jobsift.sources import sinks as K

SCHEMA = "id string, page int, position int, title string"


def job(i, page=1, title="t"):
    return {"id": i, "page": page, "position": 1, "title": title}


def by_name(report):
    return {os.path.basename(r["_file"]): (r["records"], r["malformed"], r["no_key"], r["torn"], r["superseded"], r["kept"], r["state"])
            for r in report.collect()}


def land(root, folder, files):
    (root / folder).mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (root / folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


JSON_FILES = {
    "a.json": json.dumps([job("1"), job("2"), job(None)], indent=1),
    "b.json": json.dumps([job("1", page=2, title="later")]),
    "lines.json": "\n".join(json.dumps(job(str(i))) for i in (5, 6)) + "\n",
    "cut.json": json.dumps([job("7"), job("8", title="x\ny")], indent=1)[:-30],
    "open.json": "[\n" + json.dumps(job("9")) + ",\n" + json.dumps(job("1", page=9)) + "\n",
    "empty.json": "[]", "nothing.json": "",
    "object.json": json.dumps(job("10"), indent=1),
}


def test_json_whole_files(spark, tmp_path):
    """A torn file is left out whole, as where each file is parsed alone."""
    land(tmp_path, "raw_data", JSON_FILES)
    got = FB.scan_fallback(spark, str(tmp_path), SCHEMA)
    assert sorted((r["id"], r["page"], r["title"]) for r in got.rows.collect()) == [
        ("1", 2, "later"), ("2", 1, "t"), ("5", 1, "t"), ("6", 1, "t")]
    report = by_name(got.report)
    assert report["a.json"] == (3, 0, 1, 0, 1, 1, "read") and report["b.json"] == (1, 0, 0, 0, 0, 1, "read")
    assert report["cut.json"][5:] == (0, "torn") and report["open.json"] == (2, 0, 0, 2, 0, 0, "torn")
    assert report["object.json"][5:] == (0, "torn")
    assert report["empty.json"][6] == "no records" and "nothing.json" not in report
    reasons = [r["reason"] for r in got.set_apart.collect()]
    for name, column in (("malformed", 1), ("no_key", 2), ("torn_file", 3)):
        assert reasons.count(name) == sum(r[column] for r in report.values())


def test_json_records_of_torn_files(spark, tmp_path):
    land(tmp_path, "raw_data", JSON_FILES)
    got = FB.scan_fallback(spark, str(tmp_path), SCHEMA, whole_files=False)
    assert sorted((r["id"], r["page"]) for r in got.rows.collect()) == [("1", 9), ("2", 1), ("5", 1), ("6", 1), ("7", 1), ("9", 1)]
    report = by_name(got.report)
    assert report["cut.json"] == (2, 1, 0, 0, 0, 1, "read") and report["open.json"] == (2, 0, 0, 0, 0, 2, "read")
    [cut] = [r["record"] for r in got.set_apart.where("reason = 'malformed'").collect() if "cut.json" in r["_file"]]
    assert cut.startswith("{") and '"8"' in cut


def test_json_lines_and_a_torn_one(spark, tmp_path):
    """With records by line a torn line costs no other; blank lines count nowhere."""
    lines = [json.dumps(job(str(i))) for i in range(6)]
    land(tmp_path, "raw_data", {"a.json": "\r\n".join([*lines[:3], lines[3][:20], "", "[1]", *lines[4:]]) + "\n"})
    got = FB.scan_fallback(spark, str(tmp_path), SCHEMA, whole_files=False, json_lines=True)
    assert sorted(r["id"] for r in got.rows.collect()) == ["0", "1", "2", "4", "5"]
    assert sorted(r["record"] for r in got.set_apart.collect()) == sorted([lines[3][:20], "[1]"])
    assert by_name(got.report) == {"a.json": (7, 2, 0, 0, 0, 5, "read")}


def test_unreadable_parquet_and_order_of_sources(spark, tmp_path):
    """Raw data without a usable record is passed over; an unreadable file stands in the report."""
    land(tmp_path, "raw_data", {"a.json": "[]", "b.json": '[{"id": '})
    rows = spark.createDataFrame([("1", 1, 1, "a"), ("1", 2, 1, "b"), ("2", 1, 1, "c"), (None, 1, 1, "d")], SCHEMA)
    rows.coalesce(1).write.parquet(str(tmp_path / "processed_data" / "good.parquet"))
    land(tmp_path, "processed_data", {"bad.parquet": b"PAR1 no parquet at all PAR1"})
    got = FB.scan_fallback(spark, str(tmp_path), SCHEMA)
    assert got.source.endswith("*.parquet")
    assert sorted((r["id"], r["title"]) for r in got.rows.collect()) == [("1", "b"), ("2", "c")]
    report = by_name(got.report)
    assert report.pop("bad.parquet") == (0, 0, 0, 0, 0, 0, "no records")
    assert list(report.values()) == [(4, 0, 1, 0, 1, 2, "read")]


def test_csv(spark, tmp_path):
    head = "id,page,position,title\n"
    land(tmp_path, "processed_data", {"a.csv": head + '1,1,1,"two\nlines"\n2,1,1,b\n', "b.csv": head + "3,1,1,c\n4,1\n5,x,1,e\n", "c.csv": head})
    got = FB.scan_fallback(spark, str(tmp_path), SCHEMA)
    assert sorted((r["id"], r["title"]) for r in got.rows.collect()) == [("1", "two\nlines"), ("2", "b")]
    assert by_name(got.report) == {"a.csv": (2, 0, 0, 0, 0, 2, "read"), "b.csv": (3, 2, 0, 1, 0, 0, "torn"), "c.csv": (0, 0, 0, 0, 0, 0, "no records")}
    some = FB.scan_fallback(spark, str(tmp_path), SCHEMA, whole_files=False)
    assert sorted(r["id"] for r in some.rows.collect()) == ["1", "2", "3"]
    assert sorted(r["record"] for r in some.set_apart.collect()) == ["4,1", "5,x,1,e"]


def test_no_records(spark, tmp_path):
    land(tmp_path, "raw_data", {"a.json": "[]"})
    with pytest.raises(FileNotFoundError):
        FB.scan_fallback(spark, str(tmp_path), SCHEMA)


def test_compact_batch_files(spark):
    """The fallback batch is written in both forms and read back alike; columns that are absent take their defaults."""
    jobs = spark.createDataFrame([("1", "a", "d" * 600, None), ("2", None, None, "u, \"v\"\nw")], "id string, title string, description string, url string")
    paths = K.write_batch_compact(jobs, work_path(spark, "compact"), "batch_1")
    want = [("1", "a", "", "", "d" * 500, "", "", "", False), ("2", "", "", "", "", "u, \"v\"\nw", "", "", False)]
    assert sorted(tuple(r) for r in spark.read.parquet(paths["parquet"]).collect()) == want
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths["csv"]).fillna("")
    assert sorted(tuple(r)[:8] + (r["remote"] == "true",) for r in csv.collect()) == want


def test_csv_keeps_blanks_at_the_ends(spark):
    rows = [("1", " a "), ("2", "\tb"), ("3", ""), ("4", None)]
    path = K.write_csv(spark.createDataFrame(rows, "id string, title string"), work_path(spark, "blanks"))
    assert sorted(tuple(r) for r in RD.scan_csv(spark, path, "id string, title string", K.NULL_MARK).collect()) == rows


def test_runs_too_many_to_broadcast(spark):
    """A run that holds most postings is cut into pieces; postings without a run stay."""
    postings = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 9 THEN NULL ELSE concat('r', id % 50) END AS batch_id")
    runs = spark.createDataFrame([("hot", 1), ("r7", 2), ("r8", 3), ("r99", 4)], "run_id string, n int")
    near = J.run_postings(postings, runs)
    far = J.run_postings(postings, runs, broadcast_rows=2, pieces=5)
    assert near.columns == far.columns
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect())) and far.count() == 3000
    assert "Broadcast" in near._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in far._jdf.queryExecution().executedPlan().toString()


def test_many_small_runs_are_neither_broadcast_nor_all_copied(spark):
    """Small files hide how many rows the runs have; only the run with most postings is copied, and nothing is broadcast."""
    postings = spark.range(2000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 9 THEN NULL ELSE concat('r', id) END AS batch_id")
    path = work_path(spark, "runs")
    spark.range(1, 3000).selectExpr("concat('r', id) AS run_id", "id AS n").union(spark.range(2).selectExpr("'hot' AS run_id", "-id AS n")).write.parquet(path)
    runs = spark.read.parquet(path)
    far = J.run_postings(postings, runs, broadcast_rows=100, pieces=5)
    want = postings.join(runs, postings["batch_id"] == runs["run_id"], "left")
    assert sorted(map(str, far.collect())) == sorted(map(str, want.collect())) and far.count() == 3400
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert "BroadcastHashJoin" not in far._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")[0]
    assert "SortMergeJoin" in far._jdf.queryExecution().sparkPlan().toString()
