"""Streaming forms equal the batch forms: the same files through
``availableNow`` and through a batch read give the same windows / rows."""

from pyspark.sql import functions as F

from jobsift.operators import epochs as EP
from jobsift.operators import ledger as L
from jobsift.plans import binding as B
from jobsift.session import work_path
from jobsift.sources import api as API
from jobsift.streaming import alerts as T
from jobsift.streaming import ingest as I
from compare import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _land_errors(spark):
    path = work_path(spark, "test", "errors")
    T.as_event_time(B.view(spark, SF_SMALL, "errors"), "ts").repartition(5).write.parquet(path)
    return path


def _drain_complete(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_error_windows_stream_equals_batch(spark):
    path = _land_errors(spark)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got5 = _drain_complete(T.errors_5m(stream.withWatermark("ts", "10 minutes")), "t_errors_5m")
    got1 = _drain_complete(T.error_burst(stream.withWatermark("ts", "10 minutes")), "t_error_burst")
    batch = spark.read.parquet(path)
    assert _rows(got5) == _rows(T.errors_5m(batch))
    assert _rows(got1) == _rows(T.error_burst(batch))


def test_stream_pages_equals_batch_scan(spark):
    landing = work_path(spark, "test", "pages")
    API.page_envelopes(API.api_records(B.postings(spark, SF_SMALL)), page_size=20).write.json(landing)
    out = work_path(spark, "test", "pages-out")
    I.run_to_parquet(I.stream_pages(spark, landing, max_files_per_trigger=2), out, work_path(spark, "test", "ck"))
    cols = ["id", "title", "page", "position"]
    assert _rows(spark.read.parquet(out).select(*cols)) == _rows(API.scan_page_envelopes(spark, landing).select(*cols))


def _valid(spark):
    """The fixture's postings that pass the cleaning rules: those with a list of locations."""
    return B.postings(spark, SF_SMALL).where(F.json_array_length("locations") > 0).count()


def test_restart_adds_nothing(spark):
    landing = work_path(spark, "test", "landing")
    API.page_envelopes(API.api_records(B.postings(spark, SF_SMALL)), page_size=500).write.json(landing)
    table, ckpt, ledger = (work_path(spark, "test", n) for n in ("jobs", "ckpt", "ledger"))
    I.stream_ingest(spark, landing, table, ckpt, ledger, max_files_per_trigger=1)
    found = EP.finished(spark, table)
    I.stream_ingest(spark, landing, table, ckpt, ledger, max_files_per_trigger=1)
    assert EP.finished(spark, table) == found
    assert EP.latest(spark, table).count() == _valid(spark)
    assert I.ledger(spark, ledger).agg(F.sum("row_count")).first()[0] == _valid(spark)


def _landed(spark):
    landing = work_path(spark, "test", "landing")
    API.page_envelopes(API.api_records(B.postings(spark, SF_SMALL)), page_size=50).coalesce(2).write.json(landing)
    spark.createDataFrame([('{"page": 7, "data": {"jobPo',), ('{"page": 8}',)], "value string").coalesce(1).write.mode("append").text(landing)
    return spark.read.schema(API.LANDED).json(landing)


def test_replay_and_malformed_pages(spark):
    """A replayed epoch adds nothing, to the table, the files or the ledger; broken pages and rejected rows are kept and counted."""
    landed, n, ok = _landed(spark), B.postings(spark, SF_SMALL).count(), _valid(spark)
    table, ledger, files = (work_path(spark, "test", n) for n in ("table", "ledger", "files"))
    body = I.ingest_batch(table, ledger, files_root=files)
    body(landed, 0)
    body(landed, 0)
    assert EP.latest(spark, table).count() == ok
    state = L.ledger_state(I.ledger(spark, ledger), cols=(*L.LEDGER_COLUMNS, "malformed_pages", "invalid_rows")).collect()
    assert [(r["status"], r["row_count"], r["malformed_pages"], r["invalid_rows"]) for r in state] == [("completed", ok, 2, n - ok)]
    assert state[0]["start_time"] <= state[0]["end_time"] and state[0]["processing_time"] > 0
    assert spark.read.parquet(ledger + "_quarantine/pages").count() == 2
    assert spark.read.parquet(ledger + "_quarantine/rows").where("reject_reason IS NOT NULL").count() == n - ok
    assert spark.read.json(f"{files}/epoch=0/raw_data/*").count() == ok


def test_failed_epoch_is_recorded_and_can_be_replayed(spark, monkeypatch):
    import pytest
    landed, table, ledger = _landed(spark), work_path(spark, "test", "table"), work_path(spark, "test", "ledger")
    body = I.ingest_batch(table, ledger)
    with monkeypatch.context() as m:
        m.setattr(EP, "append", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            body(landed, 0)
    state = L.ledger_state(I.ledger(spark, ledger)).first()
    assert state["status"] == "failed" and "division" in state["error_message"]
    body(landed, 0)
    assert [r["status"] for r in L.ledger_state(I.ledger(spark, ledger)).collect()] == ["completed"]
    assert EP.latest(spark, table).count() == _valid(spark)


def test_unlisted_fields_survive(spark):
    landing = work_path(spark, "test", "unlisted")
    line = '{"page": 1, "data": {"jobPosts": [{"id": 5, "title": "t", "gender": "any", "extra": {"a": [1, 2.50]}}, 7]}}'
    spark.createDataFrame([(line,)], "value string").write.text(landing)
    rows = API.flatten_posting(API.scan_page_envelopes(spark, landing), "b").orderBy("raw_data").collect()
    assert [(r["id"], r["gender"]) for r in rows] == [(None, None), ("5", "any")]
    assert '"extra":{"a":[1,2.50]}' in rows[1]["raw_data"].replace(" ", "")
