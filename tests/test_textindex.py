"""Indexed search equals the scan, for any pattern, and reads only files with candidates."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobsift.operators import search as R
from jobsift.operators import textindex as X
from jobsift.session import work_path

TEXTS = ["Senior 100% remote_job", "SENIOR engineer", None, "", "ab", "a_b%c\\d", "İstanbul ofis", "ΟΔΟΣ ΣΑΣ", "straße STRASSE",
         "\U0001f600\U0001f601\U0001f602 smile", "new\nline here", "aaaaaa", "abab ababab", "دورکاری تمام وقت", "engineer senior"]


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(str(i * 100 + j), t, u) for i, t in enumerate(TEXTS) for j, u in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id string, title string, description string").withColumns(
        {"activation_time": F.lit("2024-01-01").cast("timestamp_ntz"), "locations": F.lit('[{"city": "x"}]'),
         "company_name_en": F.lit("Acme"), "company_name_fa": F.lit(None).cast("string")})
    table = work_path(spark, "table", "texts")
    df.repartitionByRange(6, F.col("id").cast("long")).write.parquet(table)
    return df.cache(), table, X.build_index(spark, table, work_path(spark, "index", "texts"))


def _same(spark, stored, **asked):
    df, table, index = stored
    got = sorted(r["id"] for r in X.matching_rows(spark, table, index, **asked).select("id").collect())
    assert got == sorted(r["id"] for r in df.where(R.search_filter(**asked)).select("id").collect()), asked
    return got


@pytest.mark.parametrize("keyword", ["senior", "100%", "100%rem", "remote_job", "a\\_b", "se_ior", "%", "ab", "i̇stanbul", "İSTAN", "σας", "ΣΑΣ",
                                     "STRASSE", "straße", "\U0001f600\U0001f601\U0001f602", "\U0001f601\U0001f602 s", "line here", "w\nl",
                                     "aaaa", "babab", "تمام", "nowhere", "senior%engineer", "  ", "xyz%ab"])
def test_equals_scan(spark, stored, keyword):
    _same(spark, stored, keyword=keyword)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="abseniorSER%_ \n0Σσ", min_size=1, max_size=6))
def test_equals_scan_for_any_text(spark, stored, keyword):
    _same(spark, stored, keyword=keyword)


def test_several_predicates(spark, stored):
    assert _same(spark, stored, keyword="senior", location="city", company="acm")
    assert not _same(spark, stored, keyword="senior", company="nobody")
    _same(spark, stored, company="ac")  # no trigram: a scan
    _same(spark, stored)


def test_reads_only_candidate_files(spark, stored):
    _, table, index = stored
    hits = X.matching_rows(spark, table, index, keyword="remote_job", location="city")
    few = spark.read.parquet(table).where("id = '202'")
    assert len(few.inputFiles()) == 6
    # the title's rows are in the first file; descriptions hold it in every file, so ask for a title alone
    found = X.candidate_rows(spark, index, [("remote", ("title",))])
    assert found.select("file").distinct().count() < 6 and hits.count() == 29


def test_page_and_total(spark, stored):
    df, table, index = stored
    for sort in ("date", "company", "relevance"):
        page, total = X.search_indexed(spark, table, index, keyword="engineer", sort=sort, page=2, limit=7)
        expected, n = R.search(df, keyword="engineer", sort=sort, page=2, limit=7)
        assert page.select("id").collect() == expected.select("id").collect() and total.collect() == n.collect()


def test_empty_table_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 3)
    table = work_path(spark, "table", "chunks")
    spark.range(40).select(F.col("id").cast("string").alias("id"), F.format_string("row %03d", "id").alias("title"),
                           F.lit(None).cast("string").alias("description")).coalesce(1).write.parquet(table)
    index = X.build_index(spark, table, work_path(spark, "index", "chunks"))
    assert [r["id"] for r in X.matching_rows(spark, table, index, keyword="w 037").collect()] == ["37"]
    assert X.matching_rows(spark, table, index, keyword="row").count() == 40
    empty = work_path(spark, "table", "empty")
    spark.read.parquet(table).limit(0).write.parquet(empty)
    index = X.build_index(spark, empty, work_path(spark, "index", "empty"))
    assert X.matching_rows(spark, empty, index, keyword="row").count() == 0
