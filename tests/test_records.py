"""CSV and JSON arrays glued from lines, against Python's readers and the multiLine readers."""

import csv
import json
import random

import pytest

from jobsift.sources import readers as RD
from jobsift.sources import records as RC

RNG = random.Random(6)
TEXTS = ["plain", "two\nlines", "a \"quoted\" word", "\n\n", "comma, and\n\"both\",\n", "Ünï\r\ncode", "", " spaced ", "x" * 300, "line\n" * 40, "{[", "]}\\", "\\\""]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(TEXTS), rng.choice(TEXTS)) for i in range(seed * 1000, seed * 1000 + n)]


def test_csv_with_line_breaks(spark, tmp_path, small_splits):
    """Two files over many splits, values that cross them."""
    want = []
    for k in (1, 2):
        rows = rows_of(150, k) + [(k * 1000 + 999, "long\n" * 700, "end")]
        with open(tmp_path / f"f{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n" if k == 1 else "\r\n", quoting=csv.QUOTE_NONNUMERIC)
            w.writerows([("id", "a", "b"), *rows])
        want += rows
    df = RC.scan_csv_records(spark, str(tmp_path), "id long, a string, b string", null_value="\\N")
    assert RC.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted((r["id"], r["a"] or "", r["b"] or "") for r in df.collect())
    assert got == sorted(want)
    other = RD.scan_csv(spark, str(tmp_path / "f1.csv"), "id long, a string, b string", null_value="\\N", multiline=True)
    assert sorted((r["id"], r["a"] or "", r["b"] or "") for r in other.collect()) == [r for r in got if r[0] < 2000]


@pytest.mark.parametrize("form", ["pretty", "lines", "leading", "one", "packed"])
def test_json_arrays(spark, tmp_path, small_splits, form):
    rows = [{"id": i, "a": a, "b": {"c": [b, None], "d": None}} for i, a, b in rows_of(120, 3)]
    objects = [json.dumps(r, ensure_ascii=False) for r in rows]
    text = {"pretty": json.dumps(rows, indent=2, ensure_ascii=False), "lines": "[\n" + ",\n".join(objects) + "\n]\n", "leading": "[" + "\n,".join(objects) + "]",
            "one": "[" + ",".join(objects) + "]", "packed": "[" + ",\n".join(", ".join(objects[k:k + 7]) for k in range(0, 120, 7)) + " ]\n"}[form]
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text("[]\n" if form != "pretty" else "[\n]", encoding="utf-8")
    schema = "id long, a string, b struct<c:array<string>,d:string>"
    got = sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in RC.scan_json_records(spark, str(tmp_path), schema).collect())
    assert got == sorted(json.dumps(r, sort_keys=True) for r in rows)


def test_very_long_values(spark, tmp_path):
    rows = [{"id": 1, "a": "long \\ \" text " * 50_000}, {"id": 2, "a": "short"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    got = {r["id"]: r["a"] for r in RC.scan_json_records(spark, str(tmp_path / "a.json"), "id long, a string").collect()}
    assert got == {r["id"]: r["a"] for r in rows}
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows([("id", "a"), *[(r["id"], r["a"] + "\n") for r in rows]])
    got = {r["id"]: r["a"] for r in RC.scan_csv_records(spark, str(tmp_path / "a.csv"), "id long, a string").collect()}
    assert got == {r["id"]: r["a"] + "\n" for r in rows}


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n")
    (tmp_path / "b.csv").write_text("")
    assert RC.scan_csv_records(spark, str(tmp_path), "id long, a string").collect() == []
    assert RC.scan_json_records(spark, str(tmp_path / "b.csv"), "id long").collect() == []
