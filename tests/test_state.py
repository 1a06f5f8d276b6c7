"""Keyed stream state: the stop rule and the absence alert against the batch operators and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from jobsift.operators import rows as RW
from jobsift.session import work_path
from jobsift.streaming import ingest as I
from jobsift.streaming import state as ST

PAGES = "source string, page long, n_postings long, has_next boolean, failed boolean"


def run_parts(spark, parts, schema, transform, name):
    """Each part landed and drained by a restarted query."""
    src, out, ckpt = work_path(spark, "landing", name), work_path(spark, "sink", name), work_path(spark, "ckpt", name)
    for rows in parts:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        I.run_to_parquet(transform(spark.readStream.schema(schema).parquet(src)), out, ckpt)
    return spark.read.parquet(out)


@pytest.mark.parametrize("max_empty", [None, 3])
def test_stop_equals_the_batch_rule(spark, max_empty):
    """Any order inside a batch, three batches with restarts; one source at a time equals empty_page_stop."""
    rng = random.Random(4)
    rows = [("a", p, rng.choice([0, 5]) if p > 20 else 5, p != 40, rng.random() < 0.6) for p in range(60)]
    rows += [("b", p, 0 if p % 3 == 0 else 1, True, None) for p in range(1, 50)] + [(None, p, None if p > 20 else 2, None, p > 3) for p in range(30)]
    parts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 17), (17, 23), (23, 99))]
    for p in parts:
        rng.shuffle(p)
    got = run_parts(spark, parts, PAGES, lambda x: ST.stop_pages(x, max_empty), "stop").collect()
    assert len(got) == len(rows)
    for source in ("a", "b", ""):
        frame = spark.createDataFrame([(p, n or 0, h if h is not None else True) for s, p, n, h, _ in rows if (s or "") == source], "page long, n_postings long, has_next boolean")
        kept = {r["page"] for r in RW.empty_page_stop(frame, max_empty=max_empty).collect()}
        assert {r["page"] for r in got if r["source"] == source and r["status"] == "kept"} == kept
    alone = {r["page"]: (r["failure_streak"], r["alert"]) for r in got if r["source"] == ""}
    assert alone[7] == (4, False) and alone[8] == (5, True) and alone[20] == (17, True)


def test_late_pages_and_their_postings(spark):
    """A page of an earlier number that comes later is judged by the stop; postings follow their page."""
    parts = [[("a", 1, 5, True, False), ("a", 3, 5, False, False)], [("a", 2, 5, True, False), ("a", 4, 5, True, False)]]
    status = run_parts(spark, parts, PAGES, ST.stop_pages, "late")
    postings = spark.createDataFrame([("a", p, f"p{p}") for p in range(1, 5)], "source string, page long, id string")
    assert sorted(r["id"] for r in ST.until_stop(postings, status).collect()) == ["p1", "p2", "p3"]
    assert [r["id"] for r in ST.until_stop(postings, status, apart=True).collect()] == ["p4"]


def test_absence_fires_without_rows_and_clears(spark):
    schema = "source string, ts timestamp"
    hour = "timestamp'2025-01-01 00:00:00' + make_dt_interval(0, {})"

    def rows(*pairs):
        return [(r["s"], r["t"]) for s, h in pairs for r in spark.sql(f"SELECT '{s}' AS s, {hour.format(h)} AS t").collect()]

    parts = [rows(("quiet", 0), ("busy", 0), ("busy", 10)), rows(("busy", 20), ("busy", 27)), rows(("busy", 30)), rows(("quiet", 40), ("quiet", 90), ("busy", 60))]
    parts += [rows(("quiet", 10))]  # later than the watermark: dropped
    out = run_parts(spark, parts, schema, ST.no_new_alerts, "absence")
    got = sorted((r["source"], r["event"], int(r["h"]), int(r["seen"])) for r in out.select(
        "source", "event", ((F.unix_timestamp("at") - F.unix_timestamp(F.lit("2025-01-01 00:00:00"))) / 3600).alias("h"),
        ((F.unix_timestamp("last_seen") - F.unix_timestamp(F.lit("2025-01-01 00:00:00"))) / 3600).alias("seen")).collect())
    assert got == [("busy", "cleared", 60, 30), ("busy", "fired", 55, 30), ("busy", "fired", 85, 60), ("quiet", "cleared", 40, 0),
                   ("quiet", "cleared", 90, 40), ("quiet", "fired", 25, 0), ("quiet", "fired", 65, 40)]
