"""Hand-written edge rows for the column rules (bad JSON, null elements,
blank strings, every timestamp shape, ids over three digits)."""

import datetime as dt

from pyspark.sql import functions as F

from jobsift.functions import cleaning as CL
from jobsift.functions import derived as D
from jobsift.functions import formatting as N


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_location_ids_wide_ids_and_non_arrays(spark):
    rows = [('[{"province":{"id":1},"city":{"id":1234}}]',), ("[]",), ('{"bad":1}',), (None,),
            ('[{"province":{"id":7}},{"city":{"id":42}}]',)]
    got = one(spark, rows, "locations string", D.location_ids())
    assert got == ["001,1234", "", "", "", "007,042"]


def test_tag_flags_and_codes_with_null_elements(spark):
    rows = [('["امریه سربازی",null]',), (None,), ("[]",), ('["پاره وقت","کارآموزی","پاره وقت"]',)]
    assert one(spark, rows, "tags string", D.tag_flag("امریه سربازی")) == [1, 0, 0, 0]
    assert one(spark, rows, "tags string", D.tag_flag("دورکاری")) == [0, 0, 0, 0]
    assert one(spark, rows, "tags string", D.tag_number()) == ["0", "0", "0", "1,4"]


def test_category_hierarchy(spark):
    rows = [('[{"titleEn":"A"}]',), ('[{"titleEn":"A"},{"titleEn":"B"}]',), ("[]",), ('{"titleEn":"A"}',)]
    df = spark.createDataFrame(rows, "job_post_categories string").select(
        *[c.alias(n) for n, c in D.category_hierarchy().items()])
    assert [tuple(r) for r in df.collect()] == [("A", None, None), ("B", "A", "B"), (None, None, None),
                                               (None, None, None)]


def test_parse_timestamp_shapes(spark):
    rows = [("2024-01-02T03:04:05.123456Z",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",),
            ("2024-01-02",), ("2024-01-02T03:04",), ("garbage",), (None,)]
    got = one(spark, rows, "s string", CL.parse_timestamp("s"))
    assert got[:4] == [dt.datetime(2024, 1, 2, 3, 4, 5, 123456), dt.datetime(2024, 1, 2, 3, 4, 5),
                       dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2)]
    assert got[4:] == [None, None, None]
    assert one(spark, rows[4:5], "s string", CL.parse_timestamp("s", CL.DB_TS_SHAPE)) == [dt.datetime(2024, 1, 2, 3, 4)]
    assert one(spark, rows, "s string", CL.normalize_timestamp_text("s"))[:2] == [
        "2024-01-02T03:04:05.123456", "2024-01-02T03:04:05"]


def test_salary_bounds_truthiness(spark):
    rows = [('{"min":0,"max":"0"}',), ('{"min":"","max":" 12 "}',), ("negotiable",), ('{"min":100.5}',), (None,)]
    df = spark.createDataFrame(rows, "salary string").select(
        *[c.alias(n) for n, c in CL.normalize_salary("salary").items()])
    got = [tuple(r) for r in df.collect()]
    assert got[0][1:] == (None, 0.0)
    assert got[1][1:] == (None, 12.0)
    assert got[2] == ('{"raw":"negotiable"}', None, None)
    assert got[3][1:] == (100.5, None)
    assert got[4] == (None, None, None)


def test_fix_url_and_surrogate_id(spark):
    rows = [("http://a",), ("//b",), ("c.org/x",), (None,)]
    assert one(spark, rows, "url string", CL.fix_url("url")) == ["http://a", "https://b", "https://c.org/x", None]
    df = spark.createDataFrame([(None, "T", "u"), ("", "T", "u"), ("7", "T", "u")], "id string, title string, url string")
    got = [r[0] for r in df.select(CL.surrogate_id("id")).collect()]
    import hashlib
    h = hashlib.md5(b"T-u").hexdigest()
    assert got == [h, h, "7"]


def test_formatters(spark):
    df = spark.createDataFrame([(1,), (1536,), (5 * 1024 ** 3,), (None,)], "b long")
    assert [r[0] for r in df.select(N.format_filesize("b")).collect()] == ["1.0 B", "1.5 KB", "5.0 GB", None]
    df = spark.createDataFrame([("1234.5",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(N.format_currency("v")).collect()] == ["$1,234.50", "abc", ""]
    now = dt.datetime(2024, 1, 10, 12, 0, 0)
    ts = [now - dt.timedelta(seconds=30), now - dt.timedelta(minutes=1), now - dt.timedelta(hours=5),
          now - dt.timedelta(days=1), now - dt.timedelta(days=3), now - dt.timedelta(days=14),
          now - dt.timedelta(days=65), now - dt.timedelta(days=800), now + dt.timedelta(days=1)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    got = [r[0] for r in df.select(N.format_relative_time("t", F.lit(now).cast("timestamp_ntz"))).collect()]
    assert got == ["just now", "1 minute ago", "5 hours ago", "yesterday", "3 days ago", "2 weeks ago",
                   "2 months ago", "2 years ago", "in the future"]


def test_truncate_words(spark):
    long = "word " * 40
    df = spark.createDataFrame([(long,), ("short",)], "d string")
    got = [r[0] for r in df.select(D.truncate_words("d", 20)).collect()]
    assert got == ["word word word...", "short"]


def test_locations_normalised_then_validated(spark):
    from jobsift.operators import cleaning as CO
    rows = [("1", "T", "u", None), ("2", "T", "u", '{"bad":1}'), ("3", "T", "u", "Tehran"), ("4", "T", "u", '[{"a":1}]')]
    df = spark.createDataFrame(rows, "id string, title string, url string, locations string")
    got = {r["id"]: (r["locations"], r["reject_reason"]) for r in CO.clean_postings(df).collect()}
    assert got["1"] == ("[]", "empty_locations")
    assert got["2"] == ('{"bad":1}', "locations_not_list")
    assert got["3"] == ('["Tehran"]', None)
    assert got["4"] == ('[{"a":1}]', None)


def test_unparseable_activation_becomes_as_of(spark):
    from jobsift.operators import cleaning as CO
    rows = [("1", "T", "u", "[1]", "2024-01-02T03:04:05"), ("2", "T", "u", "[1]", "soon"), ("3", "T", "u", "[1]", None)]
    df = spark.createDataFrame(rows, "id string, title string, url string, locations string, activation_time string")
    got = {r["id"]: r["activation_time"] for r in CO.validate_posting(df, as_of="2024-02-01 00:00:00").collect()}
    assert got == {"1": dt.datetime(2024, 1, 2, 3, 4, 5), "2": dt.datetime(2024, 2, 1), "3": None}


def test_export_name():
    import datetime as dt
    from jobsift.sources.sinks import export_name
    ts = dt.datetime(2024, 2, 1, 3, 4, 5)
    assert export_name(ts) == "jobs_export_20240201_030405"
    assert export_name(ts, keyword="data eng/ml?", company="Café", days=7) == "jobs_export_keyword-data_eng_ml_company-Cafe_days-7_20240201_030405"
