"""Steps that grew too fast: how they read and what they shuffle and write, beside their results."""

import os

import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from compare import SF_SMALL
from jobsift.operators import cleaning as CO
from jobsift.operators import epochs as EP
from jobsift.operators import merge as U
from jobsift.operators import textindex as X
from jobsift.plans import cat_stream, registry
from jobsift.session import local_path, work_path
from jobsift.sources import api as API
from jobsift.sources import readers as RD
from jobsift.sources import records as RC
from jobsift.sources import sinks as K

registry.load_all()


def _files(root):
    return [f for _, _, names in os.walk(local_path(root)) for f in names if not f.startswith((".", "_"))]


def test_array_files_are_read_once(spark, tmp_path):
    """As the multi-line reader, but a string column that takes objects does not send it back to the file."""
    texts = {"a": '[{"id": "1", "v": {"min":1,"max":2}},\n {"id": "2", "v": "text"}, {"id": "3"}]', "b": "[]", "c": " \n", "d": '{"id": "4", "v": [1,2]}',
             "e": '[{"id": "5"}, {"id": ', "f": '[{"id": "6", "v": {"min":"x"}, "n": 3}]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    for schema in ("id string, v string", "id string, v struct<min: long, max: long>", "id string, n int"):
        got = RD.scan_json_array(spark, str(tmp_path), schema, exact=False)
        want = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (schema, got.collect(), want.collect())
    assert "FileScan json" not in got._jdf.queryExecution().executedPlan().toString()


def test_index_tasks_make_lists(spark):
    """Consecutive rows of a chunk become one list a trigram before anything is shuffled; no trigram crosses texts."""
    rows = [("f", 0, 3, b"abcab"), ("f", 0, 4, b"xabc"), ("f", 0, 9, b"ab"), ("f", 1, 0, "abc\U0001f600".encode())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["file", "chunk", "row", "text"]) for part in (rows[:1], rows[1:])]
    got = {(r["gram"], r["chunk"]): r["rows"] for b in X._gram_lists("title")(iter(batches)) for r in b.to_pylist()}
    assert got == {("abc", 0): [3, 4], ("bca", 0): [3], ("cab", 0): [3], ("xab", 0): [4], ("abc", 1): [0], ("bc\U0001f600", 1): [0]}


def test_index_holds_every_trigram(spark):
    table = work_path(spark, "growth", "table")
    texts = [f"text {i % 7} of {i}" for i in range(300)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, title string").coalesce(1).write.parquet(table)
    index = spark.read.parquet(X.build_index(spark, table, work_path(spark, "growth", "index")))
    want = {}
    for i, t in enumerate(texts):
        for gram in {t[k:k + 3] for k in range(len(t) - 2)}:
            want.setdefault(gram, []).append(i)
    assert {r["gram"]: r["rows"] for r in index.collect()} == want


def test_last_page_without_building_the_records_again(spark):
    records = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("itemIndex"))
    pages = API.page_envelopes(records, page_size=4)
    assert "ubquery" not in pages._jdf.queryExecution().optimizedPlan().toString()
    assert {r["page"]: r["data"]["hasNextPage"] for r in pages.collect()} == {0: True, 1: True, 2: False}
    no_index = API.page_envelopes(records.withColumn("itemIndex", F.lit(None).cast("long")), page_size=4).collect()
    assert sorted(not r["data"]["hasNextPage"] for r in no_index)[-1] and max(r["page"] for r in no_index) < 0


def test_landings_are_written_compressed(spark):
    assert all(f.endswith(".json.gz") for f in registry.QUERIES["flatten_posting"](spark, SF_SMALL).inputFiles())
    root = local_path(spark.sparkContext.getCheckpointDir()) + "/work"
    before = set(os.listdir(root))
    registry.QUERIES["scan_fallback_json"](spark, SF_SMALL).count()
    landed = [f for d in set(os.listdir(root)) - before if d.startswith("landing-") for f in _files(f"{root}/{d}")]
    assert landed and sum(f.endswith(".txt.gz") for f in landed) >= len(landed) / 2


def test_an_exploded_posting_does_not_carry_its_page(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page": 1, "data": {"jobPosts": [{"id": "1"}, {"id": "2", "x": 3}], "hasNextPage": true}}\n{"page": 2, "jobs": [{"id": "3"}]}\n')
    found = API.scan_page_envelopes(spark, str(tmp_path))
    explode = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate posexplode" in x]
    assert len(explode) == 1 and "has_next" in explode[0] and "data#" not in explode[0], explode
    assert [tuple(r) for r in found.select("page", "position", "has_next", "record", "id").orderBy("id").collect()] == [
        (1, 0, True, '{"id": "1"}', "1"), (1, 1, True, '{"id": "2", "x": 3}', "2"), (2, 0, None, '{"id": "3"}', "3")]


def test_cleaning_parses_a_text_once(spark):
    rows = [("1", '{"min": 1, "max": "2"}', '["a"]'), ("2", "text", "Berlin"), ("3", None, None), ("4", "[1]", '{"a": 1}'), ("5", "", "[]"), ("6", "null", "null"), ("7", '{"min": 0}', '"x"')]
    df = spark.createDataFrame([(i, "t", "u", s, l) for i, s, l in rows], "id string, title string, url string, salary string, locations string")
    cleaned = CO.clean_postings(df)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 2
    assert cleaned.columns == [*df.columns, "normalize_salary_min", "normalize_salary_max", "source", "reject_reason", "is_valid"]
    got = {r["id"]: (r["salary"], r["normalize_salary_min"], r["normalize_salary_max"], r["locations"], r["reject_reason"]) for r in cleaned.collect()}
    assert got == {"1": ('{"min": 1, "max": "2"}', 1.0, 2.0, '["a"]', None), "2": ('{"raw":"text"}', None, None, '["Berlin"]', None),
                   "3": ("", None, None, "[]", "empty_locations"), "4": ("[1]", None, None, '{"a": 1}', "locations_not_list"),
                   "5": ("", None, None, "[]", "empty_locations"), "6": ("null", None, None, "null", "locations_not_list"),
                   "7": ('{"min": 0}', None, None, '"x"', "locations_not_list")}


def test_records_are_built_after_a_shuffle(spark):
    """A table of one file does not leave the building of API records to one task."""
    postings = spark.createDataFrame([("1",)], "id string").coalesce(1)
    text = {c: F.lit(None).cast("string") for c in ("title", "url", "salary", "tags", "locations", "work_types", "job_post_categories", "raw_data",
                                                    "company_name_en", "company_name_fa", "company_id")}
    records = cat_stream._records(postings.withColumns(text | {"activation_time": F.lit(None).cast("timestamp_ntz")}))
    assert "RepartitionByExpression" in records._jdf.queryExecution().optimizedPlan().toString() and records.first()["itemIndex"] == 1


def test_lines_of_plain_splits_are_not_shuffled(spark, tmp_path):
    """CSV without line breaks in values is read by its tasks; beside it a file with such breaks is glued as before."""
    (tmp_path / "plain.csv").write_text('id,t\n1,"a ""b"""\n\n2,\n')
    RC.csv_texts(spark, str(tmp_path / "plain.csv")).write.mode("overwrite").format("noop").save()
    plain = RC.scan_csv_records(spark, str(tmp_path / "plain.csv"), "id string, t string")
    assert sorted(map(tuple, plain.collect())) == [("1", 'a "b"'), ("2", None)]
    (tmp_path / "glued.csv").write_text('id,t\n3,"x\ny ""z\nend"\n4,w\n5,"\n"\n')
    found = RC.scan_csv_records(spark, str(tmp_path), "id string, t string")
    assert sorted(map(tuple, found.collect())) == [("1", 'a "b"'), ("2", None), ("3", 'x\ny "z\nend'), ("4", "w"), ("5", "\n")]
    run = plain.select("id")
    run.collect()
    final = run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final and "rangepartitioning" not in final and "Window" not in final.split("FileScan text")[0].split("BroadcastQueryStage")[0], final


def test_arrivals_are_made_by_all_tasks(spark, tmp_path, monkeypatch):
    """Four files, one after another; the join that makes the rows is not left to the task that writes them."""
    made = []
    repartition = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *a: made.append(a) or repartition(df, *a))
    src = cat_stream._arrivals_in_order(spark, SF_SMALL)
    assert made == [(1,)] * 4 and len(spark.read.parquet(src).inputFiles()) == 4


def _batch(spark):
    rows = [("a", "1", 1), ("b", "1", 2), ("a", "2", 3), (None, "1", 4), (None, "2", 5), ("c", "1", 6), ("d", "2", 7), ("d", "1", 8)]
    return spark.createDataFrame(rows, "id string, title string, _arrival int")


def test_keys_that_come_once_are_not_aggregated(spark, monkeypatch):
    """Few, many and no repeated keys, a null key among them, give what the aggregate of all rows gives."""
    batch = _batch(spark)
    for few in (U.FEW_KEYS, 2):
        monkeypatch.setattr(U, "FEW_KEYS", few)
        for order in (None, ["_arrival"]):
            got, want = U.dedupe_reread(batch, "id", order), U.dedupe_batch(batch, "id", order)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    once = batch.where("_arrival in (2, 3, 4, 6)")
    plan = U.dedupe_reread(once)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Sort" not in plan


def test_an_import_writes_its_rows_without_a_sort(spark, tmp_path, monkeypatch):
    """A batch in which keys come once is stored by the tasks that read it."""
    merged = []
    dedupe = U.dedupe_batch
    for module in (U, EP):
        monkeypatch.setattr(module, "dedupe_batch", lambda *a: merged.append(a) or dedupe(*a))
    upload = str(tmp_path / "v.json")
    (tmp_path / "v.json").write_text('[{"id": "1", "title": "x"}, {"id": "2"}, {"title": "no id"}]')
    table = work_path(spark, "growth", "import")
    for update in (True, False):
        K.import_postings(spark, upload, table, "2024-01-01 00:00:00", schema="id string, title string", update_existing=update)
    assert not merged and {r["id"]: r["title"] for r in EP.latest(spark, table).collect()} == {"1": "x", "2": "Untitled Job"}
    (tmp_path / "v.json").write_text('[{"id": "2", "title": "first"}, {"id": "2", "title": "last"}, {"id": "3", "title": "y"}]')
    counts = K.import_postings(spark, upload, table, "2024-01-02 00:00:00", schema="id string, title string").first()
    assert merged and tuple(counts) == ("success", 3, 1, 1, 0)
    assert {r["id"]: r["title"] for r in EP.latest(spark, table).collect()} == {"1": "x", "2": "last", "3": "y"}


def test_new_keys_are_found_by_the_key_column(spark, monkeypatch):
    """Few new keys are broadcast, many meet the rows in a hash join; the held keys, a whole table, are never broadcast."""
    batch, held = _batch(spark), spark.createDataFrame([("a",), ("x",), ("c",)], "id string")
    for few, form in ((U.FEW_KEYS, "BroadcastHashJoin"), (1, "ShuffledHashJoin")):
        monkeypatch.setattr(U, "FEW_KEYS", few)
        tables = [work_path(spark, "growth", "new") for _ in range(2)]
        for table, reread in zip(tables, (True, False)):
            EP.append(held.withColumn("title", F.lit("0")), table, 1, "2024-01-01 00:00:00")
            EP.insert_new(batch, table, 2, "2024-01-02 00:00:00", order=["_arrival"], reread=reread)
        got, want = [sorted(map(str, EP.read(spark, t).collect())) for t in tables]
        assert got == want and len(got) == 6
        new = U.keys_not_in(batch, held)
        assert "Broadcast" not in new._jdf.queryExecution().executedPlan().toString()
        plan = U.keep_keys(batch, new, 3)._jdf.queryExecution().executedPlan().toString()
        assert form in plan and "SortMergeJoin" not in plan, plan


def test_a_single_later_epoch_is_not_aggregated(spark):
    """It holds a key once, so its unused columns are not even read; two later ones are folded."""
    table = work_path(spark, "growth", "later")
    rows = [spark.createDataFrame([(i, f"{n}", "long") for i in ids], "id string, title string, raw_data string") for n, ids in enumerate((["a", "b", None], ["b", "c", None], ["c", "d"]))]
    for n, batch in enumerate(rows[:2]):
        EP.append(batch, table, n + 1, f"2024-01-0{n + 1} 00:00:00")
    found = EP.latest(spark, table)
    plan = found.select("id", "title")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "raw_data" not in plan
    got = {r["id"]: (r["title"], r["created_at"].day, r["updated_at"].day) for r in found.collect()}
    assert got == {"a": ("0", 1, 1), "b": ("1", 1, 2), None: ("1", 1, 2), "c": ("1", 2, 2)}
    EP.append(rows[2], table, 3, "2024-01-03 00:00:00")
    got = {r["id"]: (r["title"], r["created_at"].day, r["updated_at"].day) for r in EP.latest(spark, table).collect()}
    assert got == {"a": ("0", 1, 1), "b": ("1", 1, 2), None: ("1", 1, 2), "c": ("2", 2, 3), "d": ("2", 3, 3)}
