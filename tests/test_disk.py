"""What a run leaves on local disk while it goes on: no shuffle files of writes that are done, no cached rows, compressed landings."""

import glob
import os
import time

from pyspark.sql import functions as F

from jobsift.operators import epochs as EP
from jobsift.operators import search as R
from jobsift.operators import textindex as X
from jobsift.plans import binding as B
from jobsift.plans import cat_stream as CS
from jobsift.session import local_path, shuffles_removed, work_path
from jobsift.sources import api as API
from jobsift.streaming import ingest as I
from compare import SF_SMALL


def _shuffles(spark) -> set[str]:
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def _left(spark, before: set[str]) -> set[str]:
    for _ in range(50):  # files are removed in the background
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.2)
    return left


def test_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == was


def test_ingest_leaves_no_shuffles_and_caches_nothing(spark, monkeypatch):
    before = _shuffles(spark)
    landing = CS._land(spark, SF_SMALL, page_size=100)
    CS._land_later(spark, SF_SMALL, landing)
    table, ledger = work_path(spark, "test", "table"), work_path(spark, "test", "ledger")
    cached, append = [], EP.append
    monkeypatch.setattr(EP, "append", lambda *a, **k: cached.append(spark._jsc.getPersistentRDDs().size()) or append(*a, **k))
    n = spark._jsc.getPersistentRDDs().size()
    I.stream_ingest(spark, landing, table, work_path(spark, "test", "ckpt"), ledger, max_files_per_trigger=1000)
    EP.rewrite(spark, table, work_path(spark, "test", "folded"))
    assert cached == [n]
    assert not _left(spark, before)


def test_landing_is_compressed_and_shuffled_once(spark):
    landing = local_path(CS._land(spark, SF_SMALL, page_size=100))
    assert glob.glob(f"{landing}/part-*") and all(f.endswith(".json.gz") for f in glob.glob(f"{landing}/part-*"))
    plan = API.posting_pages(B.postings(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page") == 1 and plan.count("REPARTITION_BY_COL") == 1


def test_pages_are_those_of_the_records(spark):
    """Also of postings without an id, of repeated ones and of none."""
    flat = B.postings(spark, SF_SMALL).limit(300)
    lost = flat.limit(5).withColumn("id", F.lit(None).cast("string"))
    rows = flat.unionByName(lost).unionByName(flat.limit(7)).cache()
    for some in (rows, lost, rows.limit(0)):
        got, expected = API.posting_pages(some, 20), API.page_envelopes(API.api_records(some), 20)
        assert sorted(got.toJSON().collect()) == sorted(expected.toJSON().collect())


def _texts(spark, n: int):
    path = work_path(spark, "test", "texts")
    spark.range(n).select(F.col("id").cast("string").alias("id"), F.format_string("same words %04d", F.col("id") % 1000).alias("title"),
                          F.when(F.col("id") % 3 == 0, "a third of them").alias("description")).coalesce(1).write.parquet(path)
    return path


def test_index_is_built_without_a_shuffle_and_small(spark):
    table, before = _texts(spark, 30_000), _shuffles(spark)
    index = X.build_index(spark, table, work_path(spark, "test", "index"))
    assert not _shuffles(spark) - before
    held = spark.read.parquet(index)
    numbers = held.agg(F.sum(F.size("rows"))).first()[0]
    assert numbers == 30_000 * 13 - 30 + 10_000 * 12  # of "0000" and "a third of them" one trigram comes twice
    assert sum(os.path.getsize(f) for f in glob.glob(f"{local_path(index)}/*.parquet")) < numbers


def test_lists_in_pieces(spark, monkeypatch):
    """A trigram's rows of one chunk may stand in several lists, split by text length and by batch."""
    monkeypatch.setattr(X, "STEP_CHARS", 200)
    monkeypatch.setattr(X, "CHUNK", 700)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        table = _texts(spark, 2_000)
        index = X.build_index(spark, table, work_path(spark, "test", "index"))
        held = spark.read.parquet(index)
        assert held.count() > held.select("gram", "column", "file", "chunk").distinct().count()
        assert held.where(F.array_sort("rows") != F.col("rows")).count() == 0
        whole = spark.read.parquet(table)
        for keyword in ("words 07", "third of", "same%0123", "none"):
            got = sorted(r["id"] for r in X.matching_rows(spark, table, index, keyword=keyword).collect())
            assert got == sorted(r["id"] for r in whole.where(R.search_filter(keyword)).collect())
    finally:
        spark.conf.set(name, was)
