"""Resume rules and exact de-duplication over a bounded state."""

import datetime as dt

from pyspark.sql import functions as F

from jobsift.operators import epochs as EP
from jobsift.plans import binding as B
from jobsift.session import work_path
from jobsift.sources import api as API
from jobsift.streaming import ingest as I
from jobsift.streaming import resume as RE
from compare import SF_SMALL


def _land(spark, path, rows):
    """A file of (id, day); days are of 2024."""
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for i, d in rows], "id string, ts timestamp").coalesce(
        1).write.mode("append").parquet(path)


def test_exact_dedupe_over_restarts(spark):
    src, table, late, ckpt = (work_path(spark, "test", n) for n in ("src", "table", "late", "ckpt"))
    rows = []

    def run():
        stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        q = I.stream_dedupe_exact(stream, table, ckpt, delay="2 days", late=late)
        I.settle_late(spark.read.parquet(src), table, late)
        rows.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])

    _land(spark, src, [(f"a{i}", 1) for i in range(50)] + [("a1", 1), ("a1", 2)])
    _land(spark, src, [("a2", 3), ("b", 30)])
    run()
    _land(spark, src, [("a3", 31), ("b", 31), ("c", 5), ("c", 6), ("d", 31)])  # a3's state is gone; c is behind the watermark
    run()
    _land(spark, src, [("c", 40), ("d", 60), ("e", 60), (None, 60)])  # c is held as late
    run()
    run()
    stored = sorted(r["id"] or "" for r in EP.read(spark, table).collect())
    assert stored == sorted([f"a{i}" for i in range(50)] + ["b", "d", "e", ""])
    assert [r["id"] for r in EP.read(spark, late).collect()] == ["c"]
    assert max(rows) >= 50 and rows[-1] < 10  # the state falls


def test_resume_rules(spark):
    at = dt.datetime(2024, 1, 10, 12)
    rows = [("a", p, at - dt.timedelta(hours=30 - p)) for p in range(1, 21)]  # last arrival 10 hours ago
    rows += [("b", p, at - dt.timedelta(hours=48)) for p in range(1, 4)] + [("c", 2, at - dt.timedelta(hours=24)), ("d", 1, at + dt.timedelta(hours=1))]
    index = spark.createDataFrame(rows, "source string, page long, arrival timestamp_ntz")
    plan = RE.resume_plan(index, at)
    assert {(r["source"], r["resumed"], r["first_page"]) for r in plan.collect()} == {("a", True, 15), ("b", False, 1), ("c", True, 1)}
    again = RE.pages_to_replay(index, plan, at).groupBy("source").count().collect()
    assert {tuple(r) for r in again} == {("a", 6), ("b", 3), ("c", 1)}
    assert RE.resume_plan(index.limit(0), at).count() == 0


def test_replays_change_nothing(spark):
    """Three restarts take the last pages of the landing again; the stored table does not change."""
    landing, table = work_path(spark, "test", "landing"), work_path(spark, "test", "table")
    API.page_envelopes(API.api_records(B.postings(spark, SF_SMALL)), page_size=100).write.json(landing)
    spark.createDataFrame([('{"page": 3, "data": {"jobPo',)], "value string").write.mode("append").text(landing)
    whole = I.clean_batch(spark.read.schema(API.LANDED).json(landing), "b").where("is_valid").drop("is_valid", "reject_reason")
    EP.append(whole, table, 1, "2024-01-01 00:00:00", order=["_page", "_position"])
    index = RE.landing_index(spark, landing).withColumn("source", F.lit("api"))
    now = index.agg(F.max("arrival")).first()[0] + dt.timedelta(hours=1)
    last = index.agg(F.max("page")).first()[0]
    for n in range(3):
        pages = RE.pages_to_replay(index, RE.resume_plan(index, now), now)
        assert {r["page"] for r in pages.collect()} == set(range(last - 5, last + 1))
        EP.append(whole.join(pages.select(F.col("page").alias("_page")).distinct(), "_page"), table, n + 2, "2024-01-02 00:00:00",
                  order=["_page", "_position"])
        assert EP.changes(spark, table, n + 1, n + 2, "2024-01-02 00:00:00").count() == 0
    assert EP.latest(spark, table).count() == spark.read.parquet(f"{table}/epoch=1").count()
