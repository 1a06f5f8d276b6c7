"""Numbers of keys: gap-free, in order, stable over replays and after a dead job; links through merged rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobsift.operators import numbering as N
from jobsift.session import local_path, work_path
from jobsift.sources import sinks as K


def _keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def _given(df):
    return {r["k"]: r["number"] for r in df.collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["", "a", "B", "é", "zz", None, "10", "9", "x y"]), max_size=12), min_size=1, max_size=3))
def test_batches(spark, batches):
    root, expected = work_path(spark, "numbers"), {}
    for batch in batches:
        for k in sorted({k for k in batch if k is not None} - set(expected), key=lambda k: k.encode()):
            expected[k] = len(expected) + 1
        assert _given(N.number_keys(_keys(spark, batch), "k", root)) == expected
    assert _given(N.number_keys(_keys(spark, batches[0]), "k", root)) == expected  # a replay adds nothing


def test_dead_job_and_hot_key(spark):
    root = work_path(spark, "numbers")
    N.number_keys(_keys(spark, ["b"] * 5000 + ["a"]), "k", root)
    spark.createDataFrame([("c", 99)], "k string, number long").write.parquet(f"{root}/epoch=2")
    import os
    os.remove(os.path.join(local_path(root), "epoch=2", "_SUCCESS"))
    assert _given(N.number_keys(_keys(spark, ["d", "c", "a"]), "k", root)) == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_migration(spark):
    jobs = spark.createDataFrame([(1, "s1", "old"), (2, "s1", "new"), (3, None, "three"), (None, None, "lost")],
                                 "id long, job_id string, title string")
    tags = spark.createDataFrame([(1, "x", None), (2, "x", "later"), (3, "y", "")], "id long, name string, description string")
    links = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (3, 3), (3, 3), (9, 1), (1, 9), (None, 9)], "job_id long, tag_id long")
    root = work_path(spark, "numbers")
    for _ in range(2):
        out = K.migrate_tables(jobs, tags, links, root)
        assert {(r["id"], r["source_id"], r["title"]) for r in out["jobs"].collect()} == {(1, "3", "three"), (2, "s1", "new")}
        assert {tuple(r) for r in out["tags"].select("id", "name", "description").collect()} == {(1, "x", "later"), (2, "y", "")}
        assert sorted(map(tuple, out["job_tags"].collect())) == [(1, 2), (2, 1), (2, 2)]
        assert {tuple(r) for r in out["orphans"].collect()} == {("9", "1", "job"), ("1", "9", "tag"), (None, "9", "job tag")}
    none = K.migrate_tables(jobs.limit(0), tags.limit(0), links, work_path(spark, "numbers"))
    assert none["jobs"].count() == none["job_tags"].count() == 0 and none["orphans"].count() == 7
