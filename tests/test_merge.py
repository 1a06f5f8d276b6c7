"""Merge and audit properties: a repeated batch is a no-op, counts add up,
rows outside the batch are untouched; tables of epochs stay whole."""

import pytest
from pyspark.sql import functions as F

from jobsift.operators import epochs as EP
from jobsift.operators import merge as U
from jobsift.operators import rows as RW
from jobsift.plans import binding as B
from jobsift.session import work_path
from compare import SF_SMALL


def test_upsert_idempotent_and_counts(spark):
    p = B.postings(spark, SF_SMALL)
    v2 = B.view(spark, SF_SMALL, "postings_v2")
    t = U.with_audit_columns(p, "2024-01-01 00:00:00")
    once = U.upsert(t, v2, "2024-01-02 00:00:00")
    twice = U.upsert(once, v2, "2024-01-02 00:00:00")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    c = U.upsert_counts(t, v2).first()
    assert c["inserted"] + c["updated"] == v2.select("id").distinct().count()
    untouched = p.join(v2.select("id"), "id", "left_anti")
    merged = once.join(untouched.select("id"), "id", "left_semi").drop("created_at", "updated_at")
    assert merged.exceptAll(untouched).count() == 0


def test_audit_feed_counts(spark):
    p = B.postings(spark, SF_SMALL)
    v2 = B.view(spark, SF_SMALL, "postings_v2")
    feed = U.audit_feed(p, v2, "2024-01-02 00:00:00")
    by = {r["action"]: r["count"] for r in feed.groupBy("action").count().collect()}
    removed = p.where(F.col("id").cast("long") % 10 == 0).count()
    assert by["DELETE"] == removed and by["INSERT"] == removed
    assert by["UPDATE"] == p.where(F.col("id").cast("long") % 10 == 1).count()


def test_dedupe_is_two_phase_aggregate(spark):
    arr = B.view(spark, SF_SMALL, "arrivals")
    plan = RW.dedupe_first(arr)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_prefix_agg_matches_global_window(spark):
    from pyspark.sql import Window
    ev = B.table(spark, SF_SMALL, "events").select("event_id", "value")
    got = RW.prefix_agg(ev, ["event_id"], {"s": (F.col("value"), "sum"), "m": (F.col("value"), "max")})
    w = Window.orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    exp = ev.select("event_id", F.sum("value").over(w).alias("s2"), F.max("value").over(w).alias("m2"))
    bad = got.join(exp, "event_id").where((F.abs(F.col("s") - F.col("s2")) > 1e-6) | (F.col("m") != F.col("m2")))
    assert bad.count() == 0


def test_list_exports(spark):
    from jobsift.sources import sinks as K
    root = work_path(spark, "test", "exports")
    p = B.postings(spark, SF_SMALL)
    K.write_csv(p, f"{root}/jobs.csv")
    K.write_json(p, f"{root}/jobs.json", array=True)
    K.write_sql_inserts(p.withColumn("company", F.col("company_name_en")), f"{root}/jobs.sql")
    got = {r["name"]: (r["format"], r["size"] > 0) for r in K.list_exports(spark, root).collect()}
    assert got == {"jobs.csv": ("csv", True), "jobs.json": ("json", True), "jobs.sql": ("sql", True)}


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_exact_quantiles_split_a_hot_group(spark):
    from jobsift.operators.quantiles import exact_quantiles
    rows = [("hot", 5.0)] * 3000 + [("hot", float(i)) for i in range(1000)] + [("cold", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, ["g"], "v", (0.25, 0.5, 0.9)).collect()}
    hot = sorted(v for g, v in rows if g == "hot")

    def q(vals, p):
        pos = p * (len(vals) - 1)
        lo, hi = int(pos // 1), int(-(-pos // 1))
        return vals[lo] + (pos - lo) * (vals[hi] - vals[lo])
    for p in (0.25, 0.5, 0.9):
        assert abs(got[("hot", p)] - q(hot, p)) < 1e-9
        assert abs(got[("cold", p)] - q([float(i) for i in range(10)], p)) < 1e-9


def test_upsert_keeps_what_the_batch_lacks(spark):
    target = U.with_audit_columns(spark.createDataFrame([("a", "t", "u"), ("b", "t", "u")], "id string, title string, url string"), "2024-01-01 00:00:00")
    batch = spark.createDataFrame([("a", "Z first", 1), ("a", "A last", 2), ("c", "new", 1)], "id string, title string, arrival int")
    rows = {r["id"]: r for r in U.upsert(target, batch, "2024-01-02 00:00:00", order=["arrival"]).collect()}
    assert (rows["a"]["title"], rows["a"]["url"], rows["b"]["url"], rows["b"]["arrival"], rows["c"]["url"]) == ("A last", "u", "u", None, None)


def test_epochs_equal_upserts(spark):
    """Epochs, an insert-only one among them, against the frame-level merges; a rewrite changes no row and deletes."""
    p, v2 = B.postings(spark, SF_SMALL), B.view(spark, SF_SMALL, "postings_v2")
    root = work_path(spark, "test", "epochs")
    with pytest.raises(FileNotFoundError):
        EP.latest(spark, root)
    days = [f"2024-01-0{i} 00:00:00" for i in range(1, 5)]
    b5 = p.where(F.col("batch_id") == "b5").withColumn("title", F.lit("x"))
    EP.append(p.where(F.col("batch_id") != "b3"), root, EP.next_epoch(spark, root), days[0])
    EP.insert_new(p, root, EP.next_epoch(spark, root), days[1])
    EP.append(v2, root, EP.next_epoch(spark, root), days[2])
    EP.append(b5, root, EP.next_epoch(spark, root), days[3])
    want = U.with_audit_columns(p.where(F.col("batch_id") != "b3"), days[0])
    want = U.upsert(U.upsert(U.insert_only(want, p, days[1]), v2, days[2]), b5, days[3])
    assert _same(EP.latest(spark, root), want)
    assert EP.latest(spark, root, upto=2).count() == p.count()
    gone = p.where(F.col("batch_id") == "b5").select("id")
    fresh = EP.rewrite(spark, root, work_path(spark, "test", "fresh"), without=gone)
    assert EP.finished(spark, fresh) == [4] and _same(EP.latest(spark, fresh), U.delete_by_id(want, gone))


def test_epoch_of_a_dead_job_is_not_read(spark):
    import os
    from jobsift.session import local_path
    root = work_path(spark, "test", "dead")
    p = B.postings(spark, SF_SMALL)
    EP.append(p, root, 1, "2024-01-01 00:00:00")
    changed = p.where(F.col("id") == "42").withColumn("title", F.lit("changed"))
    EP.append(changed.withColumn("id", F.lit("dead")), root, 2, "2024-01-02 00:00:00")
    os.remove(local_path(f"{root}/epoch=2/_SUCCESS"))
    assert EP.latest(spark, root).count() == p.count() and EP.next_epoch(spark, root) == 2
    for _ in range(2):  # the retry, and a replay of it
        EP.append(changed, root, 2, "2024-01-02 00:00:00")
    table = EP.latest(spark, root)
    assert table.count() == p.count() and table.where("id = '42'").first()["title"] == "changed"


def test_an_epoch_carries_every_column(spark):
    root = work_path(spark, "test", "columns")
    p = B.postings(spark, SF_SMALL)
    EP.append(p, root, 1, "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        EP.append(p.select("id", "title"), root, 2, "2024-01-02 00:00:00")
    EP.append(p.limit(3).withColumn("shift", F.lit("night")), root, 2, "2024-01-02 00:00:00")
    assert {r["shift"]: r["count"] for r in EP.latest(spark, root).groupBy("shift").count().collect()} == {None: p.count() - 3, "night": 3}


def test_an_epoch_keeps_the_last_arrival(spark):
    root = work_path(spark, "test", "arrivals")
    batch = spark.createDataFrame([("a", "Z first", 1), ("a", "A last", 2)], "id string, title string, _arrival int")
    EP.append(batch, root, 1, "2024-01-01 00:00:00", order=["_arrival"])
    table = EP.latest(spark, root)
    assert table.first()["title"] == "A last" and table.columns == ["id", "title", "created_at", "updated_at"]


def test_changes_between_epochs(spark):
    root = work_path(spark, "test", "changes")
    p = B.postings(spark, SF_SMALL)
    few = p.where(F.col("id").isin("3", "5", "8")).withColumn("title", F.lit("retitled"))
    EP.append(p, root, 1, "2024-01-01 00:00:00")
    EP.append(few, root, 2, "2024-01-02 00:00:00")
    EP.append(few.withColumn("id", F.concat(F.lit("new"), "id")), root, 3, "2024-01-03 00:00:00")
    feed = EP.changes(spark, root, 1, 3, "2024-01-03 00:00:00")
    assert {r["action"]: r["count"] for r in feed.groupBy("action").count().collect()} == {"UPDATE": 3, "INSERT": 3}


def test_array_exports_are_bounded(spark):
    from jobsift.sources import readers as RD
    from jobsift.sources import sinks as K
    p = B.postings(spark, SF_SMALL)
    path = K.write_json(p, work_path(spark, "test", "bounded.json"), rows_per_file=100)
    sizes = [r["n"] for r in spark.read.text(path).select(F.json_array_length("value").alias("n")).collect()]
    assert sum(sizes) == p.count() and max(sizes) <= 100
    assert RD.count_import_records(spark, path, "json").first()[0] == p.count()
    csv = K.write_csv(p, work_path(spark, "test", "all.csv"))
    assert RD.count_import_records(spark, csv, "csv").first()[0] == p.count()
