"""Catalog: sources and sinks as write-then-read round trips (S01-S11, K01-K15,
C01-C02).  Every query lands data Spark derives from the test tables in a
fresh folder under the session's checkpoint dir and reads it back."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions import derived as D
from ..operators import epochs as EP
from ..operators import filters as FL
from ..operators import merge as U
from ..operators import search as R
from ..session import work_path
from ..sources import api as API
from ..sources import fallback as FB
from ..sources import readers as RD
from ..sources import records as RC
from ..sources import sinks as K
from . import binding as B
from .oracle import with_views
from .registry import register

W = with_views("postings")
_P_SQL = W + "SELECT * FROM postings"
POSTINGS_SCHEMA = ("id string, title string, company_name_en string, company_name_fa string, company_id string, "
                   "activation_time timestamp_ntz, url string, locations string, work_types string, tags string, "
                   "job_post_categories string, salary string, raw_data string, batch_id string")
TS = _dt.datetime(2024, 2, 1, 0, 0, 0)


def P(s, d):
    return B.postings(s, d)


def _json_array_roundtrip(s, d):
    path = K.write_json(P(s, d), work_path(s, "export", "postings.json"), array=True)
    return RD.scan_json_array(s, path, POSTINGS_SCHEMA)


register("scan_json_array", _P_SQL)(_json_array_roundtrip)


def _json_lines_roundtrip(s, d):
    path = K.write_json(P(s, d), work_path(s, "export", "postings.jsonl"), array=False)
    return RD.scan_json_lines(s, path, POSTINGS_SCHEMA)


register("write_json", _P_SQL)(_json_lines_roundtrip)


def _csv_roundtrip(s, d):
    path = K.write_csv(P(s, d), work_path(s, "export", "postings.csv"))
    return RD.scan_csv(s, path, POSTINGS_SCHEMA, K.NULL_MARK)


register("scan_csv", _P_SQL)(_csv_roundtrip)


def _parquet_roundtrip(s, d):
    return RD.scan_parquet(s, K.write_parquet(P(s, d), work_path(s, "export", "postings.parquet")))


register("scan_parquet", _P_SQL)(_parquet_roundtrip)


def _auto_gz(s, d):
    path = K.write_compressed(P(s, d), work_path(s, "export", "postings") + ".csv.gz", "csv")
    return RD.scan_auto(s, path, schema=POSTINGS_SCHEMA, null_value=K.NULL_MARK)


register("scan_auto", _P_SQL)(_auto_gz)


def _compressed_json(s, d):
    path = K.write_compressed(P(s, d), work_path(s, "export", "postings") + ".json.gz", "json")
    return RD.scan_compressed(s, path, "json", POSTINGS_SCHEMA).select(*B.POSTING_COLUMNS)


register("scan_compressed", _P_SQL)(_compressed_json)


def _filtered(s, d):
    path = K.write_parquet(P(s, d), work_path(s, "table", "jobs"), partition_by=["batch_id"])
    df = s.read.parquet(path)
    return RD.scan_filtered(df, "1996-01-01", "1999-12-31 23:59:59", batch_id="b3", limit=0).select(*B.POSTING_COLUMNS)


register("scan_filtered", W + """SELECT * FROM postings WHERE activation_time >= TIMESTAMP '1996-01-01'
  AND activation_time <= TIMESTAMP '1999-12-31 23:59:59' AND batch_id = 'b3'""")(_filtered)


def _fallback(s, d):
    root = work_path(s, "landing")
    K.write_parquet(B.view(s, d, "arrivals"), f"{root}/processed_data/part.parquet")
    return RD.scan_with_fallback(s, root)


_ARR_COLS = ("id, title, company_name_en, company_name_fa, company_id, activation_time, url, locations, "
             "work_types, tags, job_post_categories, salary, raw_data, batch_id, page, position")
register("scan_with_fallback", with_views("arrivals") + f"""SELECT {_ARR_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY page DESC, position DESC) AS rn FROM arrivals
  WHERE id IS NOT NULL) t WHERE rn = 1""")(_fallback)


_ARRIVAL_SCHEMA = POSTINGS_SCHEMA + ", page int, position int"
_TORN = "length(id) > 0 AND page % 3 = 1 AND position % 4 = 2"


def _land_arrivals(s, d, fmt):
    """Arrivals as text in folders by lot (page modulo 8); every twelfth or so is cut off in its middle."""
    root = work_path(s, "landing")
    rows = B.view(s, d, "arrivals").select(*[c.strip() for c in _ARR_COLS.split(",")])
    lot = F.pmod("page", F.lit(8)).alias("lot")
    torn = rows.where(_TORN)
    whole = rows.where(f"({_TORN}) IS NOT TRUE")
    if fmt == "json":
        path = f"{root}/raw_data/arrivals.json"
        whole.select(F.to_json(F.struct(*rows.columns)).alias("value"), lot).write.options(compression="gzip", maxRecordsPerFile=200_000).partitionBy("lot").text(path)
        torn.select(F.format_string('{"id": "%s", "page": %d, "position": %d, "title":', "id", "page", "position").alias("value"),
                    lot).write.mode("append").partitionBy("lot").text(path)
    else:
        s.range(1).select(F.lit("[]").alias("value")).write.text(f"{root}/raw_data/none.json")
        path = f"{root}/processed_data/arrivals.csv"
        opts = {"header": True, "escape": '"', "nullValue": K.NULL_MARK}
        whole.select("*", lot).write.options(**opts).partitionBy("lot").csv(path)
        torn.select("id", "page", lot).write.options(**opts).mode("append").partitionBy("lot").csv(path)
    return FB.scan_fallback(s, root, _ARRIVAL_SCHEMA, whole_files=False, null_value=K.NULL_MARK, json_lines=True)


_KEPT_SQL = with_views("arrivals").rstrip("\n") + f""",
whole AS (SELECT * FROM arrivals WHERE ({_TORN}) IS NOT TRUE),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page DESC, position DESC) AS rn FROM whole
  WHERE id IS NOT NULL) t WHERE rn = 1)
"""
register("scan_fallback_json", _KEPT_SQL + f"SELECT {_ARR_COLS} FROM kept")(lambda s, d: _land_arrivals(s, d, "json").rows)
register("scan_fallback_csv", _KEPT_SQL + f"SELECT {_ARR_COLS} FROM kept")(lambda s, d: _land_arrivals(s, d, "csv").rows)
_BY_LOT = """SELECT page % 8 AS lot, count(*) AS records, count(*) FILTER ({torn}) AS malformed,
  count(*) FILTER (id IS NULL) AS no_key FROM arrivals GROUP BY 1"""
register("scan_fallback_report", _KEPT_SQL + f"""SELECT CAST(a.lot AS INTEGER) AS lot, records, malformed, no_key,
  records - malformed - no_key - coalesce(k.n, 0) AS superseded, coalesce(k.n, 0) AS kept
FROM ({_BY_LOT.format(torn=_TORN)}) a LEFT JOIN (SELECT page % 8 AS lot, count(*) AS n FROM kept GROUP BY 1) k ON a.lot = k.lot""")(
    lambda s, d: _land_arrivals(s, d, "json").report
    .groupBy(F.regexp_extract("_file", "/lot=([0-9]+)/", 1).cast("int").alias("lot"))
    .agg(*[F.sum(c).cast("long").alias(c) for c in ("records", "malformed", "no_key", "superseded", "kept")]))
register("scan_fallback_set_apart", with_views("arrivals") + f"""SELECT CAST(page % 8 AS INTEGER) AS lot, 'malformed' AS reason,
  '{{"id": "' || id || '", "page": ' || page || ', "position": ' || position || ', "title":' AS record FROM arrivals WHERE {_TORN}""")(
    lambda s, d: _land_arrivals(s, d, "json").set_apart.where("reason = 'malformed'")
    .select(F.regexp_extract("_file", "/lot=([0-9]+)/", 1).cast("int").alias("lot"), "reason", "record"))


def _land_pages(s, d):
    pages = API.page_envelopes(API.api_records(P(s, d)), page_size=50)
    path = work_path(s, "landing", "pages")
    pages.write.json(path)
    return path


def _pages(s, d):
    return API.scan_page_envelopes(s, _land_pages(s, d))


register("scan_page_envelopes", W + """SELECT id, title, CAST(id AS BIGINT) // 50 AS page,
  CAST(CAST(id AS BIGINT) % 50 AS INTEGER) AS position FROM postings""")(
    lambda s, d: _pages(s, d).select("id", "title", "page", "position"))



def _corrupt_pages(s, d):
    path = _land_pages(s, d)
    broken = P(s, d).select(F.floor(F.col("id").cast("long") / 50).alias("page")).distinct()
    broken.select(F.format_string('{"page": %d, "data": {"jobPosts": [', "page").alias("value")).write.mode("append").text(path)
    return API.malformed_pages(s, path).select("record")


# every page also lands once cut off in its middle: these lines are found, the whole pages are not
register("scan_pages_corrupt", W + """SELECT DISTINCT '{"page": ' || (CAST(id AS BIGINT) // 50) || ', "data": {"jobPosts": [' AS record FROM postings""")(
    _corrupt_pages)

_LOC_IDS = """CASE WHEN json_type(locations) = 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(flatten(
      list_transform(from_json(locations, '[{"province":{"id":"BIGINT"},"city":{"id":"BIGINT"}}]'),
                     lambda x: [x.province.id, x.city.id])), lambda y: y IS NOT NULL), lambda z: printf('%03d', z)), ','), '')
       ELSE '' END"""
_codes = " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.TAG_CODES.items())
_TAG_NO = f"""CASE WHEN json_type(tags) = 'ARRAY' THEN coalesce(nullif(array_to_string(list_sort(list_distinct(
      list_transform(from_json(tags, '["VARCHAR"]'), lambda t: CASE t {_codes} ELSE 0 END))), ','), ''), '0')
       ELSE '0' END"""
# fields that the fixture's postings lack, and one ("shift") that no table column holds
_API_FIELDS = {
    "gender": "if(id % 3 = 0, null, concat('g', id % 3))", "companyFaName": "company_name_fa",
    "provinceMatchCity": "concat('p', id % 5)", "normalizeSalaryMin": "id / 4", "normalizeSalaryMax": "id / 2",
    "paymentMethod": "concat('pay', id % 2)", "district": "concat('d', id % 7)", "companyTitleFa": "company_name_fa",
    "jobBoardId": "id % 11", "jobBoardTitleEn": "concat('Board ', id % 11)", "shift": "concat('night ', id)"}


def _full_pages(s, d):
    extra = P(s, d).withColumn("id", F.col("id").cast("long")).select(
        F.col("id").cast("string").alias("id"), *[F.expr(e).alias(n) for n, e in _API_FIELDS.items()])
    path = work_path(s, "landing", "pages")
    API.page_envelopes(API.api_records(P(s, d)).join(extra, "id")).write.options(compression="gzip", maxRecordsPerFile=4_000).json(path)
    return API.scan_page_envelopes(s, path)


register("flatten_posting", W + f"""SELECT id, title, url, company_id, company_name_en, company_name_fa,
  activation_time, {_LOC_IDS} AS location_ids, {_TAG_NO} AS tag_number, salary, 'b1' AS batch_id,
  TIMESTAMP '{TS}' AS batch_date, CAST(id AS BIGINT) AS item_index,
  CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN 'g' || CAST(id AS BIGINT) % 3 END AS gender,
  company_name_fa AS company_fa_name, 'p' || CAST(id AS BIGINT) % 5 AS province_match_city,
  CAST(id AS BIGINT) / 4 AS normalize_salary_min, CAST(id AS BIGINT) / 2 AS normalize_salary_max,
  'pay' || CAST(id AS BIGINT) % 2 AS payment_method, 'd' || CAST(id AS BIGINT) % 7 AS district,
  company_name_fa AS company_title_fa, CAST(CAST(id AS BIGINT) % 11 AS VARCHAR) AS job_board_id,
  'Board ' || CAST(id AS BIGINT) % 11 AS job_board_title_en, 'night ' || id AS shift,
  CAST(NULL AS VARCHAR) AS company_about, CAST(NULL AS VARCHAR) AS company_url,
  CAST(coalesce(CASE WHEN json_type(locations) = 'ARRAY' THEN json_array_length(locations) END, 0) AS BIGINT) AS n_locations,
  CAST(coalesce(CASE WHEN json_type(work_types) = 'ARRAY' THEN json_array_length(work_types) END, 0) AS BIGINT) AS n_work_types,
  CAST(coalesce(CASE WHEN json_type(job_post_categories) = 'ARRAY' THEN json_array_length(job_post_categories) END, 0) AS BIGINT) AS n_categories,
  CAST(coalesce(CASE WHEN json_type(tags) = 'ARRAY' THEN json_array_length(tags) END, 0) AS BIGINT) AS n_tags
FROM postings""")(
    lambda s, d: API.flatten_posting(_full_pages(s, d), "b1", TS).select(
        "id", "title", "url", "company_id", "company_name_en", "company_name_fa", "activation_time", "location_ids",
        "tag_number", "salary", "batch_id", "batch_date", "item_index", "gender", "company_fa_name", "province_match_city",
        "normalize_salary_min", "normalize_salary_max", "payment_method", "district", "company_title_fa", "job_board_id",
        "job_board_title_en", F.get_json_object("raw_data", "$.shift").alias("shift"), "company_about", "company_url",
        *[F.coalesce(F.json_array_length(c), F.lit(0)).cast("long").alias(n) for c, n in (
            ("locations", "n_locations"), ("work_types", "n_work_types"), ("job_post_categories", "n_categories"), ("tags", "n_tags"))]))
register("posting_from_api", W + """SELECT id, title,
  CASE WHEN coalesce(company_name_en, '') = '' AND coalesce(company_name_fa, '') = '' THEN company_name_en ELSE company_name_en END AS company_name_en,
  company_name_fa, activation_time FROM postings""")(
    lambda s, d: API.posting_from_api(_pages(s, d)))


def _sql_inserts(s, d):
    return K.write_sql_inserts(P(s, d).withColumn("company", F.coalesce("company_name_en", "company_name_fa")),
                               work_path(s, "export", "postings.sql"))


register("count_import_records", W + "SELECT CAST(count(*) AS BIGINT) AS records FROM postings")(
    lambda s, d: RD.count_import_records(s, _sql_inserts(s, d), "sql"))
register("write_sql_inserts", W + """SELECT '-- jobs export' AS value
UNION ALL
SELECT concat('INSERT INTO jobs (id, title, company) VALUES (''', replace(coalesce(id, ''), '''', ''''''), ''', ''',
              replace(coalesce(title, ''), '''', ''''''), ''', ''',
              replace(coalesce(coalesce(company_name_en, company_name_fa), ''), '''', ''''''), ''');') FROM postings""")(
    lambda s, d: s.read.text(_sql_inserts(s, d)))
register("count_import_json", W + "SELECT CAST(count(*) AS BIGINT) AS records FROM postings")(
    lambda s, d: RD.count_import_records(
        s, K.write_json(P(s, d), work_path(s, "export", "count.json")), "json"))


def _triple(s, d):
    root = work_path(s, "batches")
    info = K.write_batch_triple(P(s, d), root, 7, TS)
    return s.read.parquet(info["parquet"])


register("write_batch_triple", _P_SQL)(_triple)


def _manifest(s, d):
    root = work_path(s, "batches")
    df = P(s, d)
    info = K.write_batch_triple(df, root, 3, TS)
    rows = s.read.parquet(info["parquet"]).count()
    K.batch_manifest(s, f"{root}/_manifest", 3, info["name"], TS, rows, info)
    return s.read.parquet(f"{root}/_manifest").select("batch_no", "name", "row_count", F.size("paths").alias("n_paths"))


register("batch_manifest", W + """SELECT 3 AS batch_no, 'batch_0003_20240201_000000' AS name,
  CAST(count(*) AS BIGINT) AS row_count, 3 AS n_paths FROM postings""")(_manifest)
register("write_batch_compact", with_views("postings_text") + """SELECT coalesce(id, '') AS id, coalesce(title, '') AS title,
  coalesce(nullif(company_name_en, ''), company_name_fa, '') AS company, '' AS location,
  left(coalesce(description, ''), 500) AS description, coalesce(url, '') AS url,
  coalesce(CAST(activation_time AS VARCHAR), '') AS posted_date, '' AS job_type, false AS remote FROM postings_text""")(
    lambda s, d: K.compact_columns(B.view(s, d, "postings_text")))


def _compact_files(s, d):
    paths = K.write_batch_compact(B.view(s, d, "postings_text"), work_path(s, "batches"), "batch_0007")
    stored, text = RD.scan_parquet(s, paths["parquet"]), RC.scan_csv_records(s, paths["csv"], "id string, title string, company string, "
        "location string, description string, url string, posted_date string, job_type string, remote boolean", K.NULL_MARK)
    return stored.select(F.lit("parquet").alias("form"), "*").unionByName(text.select(F.lit("csv").alias("form"), "*")).select(
        "form", "id", "title", "company", F.length("description").cast("long").alias("n_description"), "posted_date", "remote")


register("write_batch_compact_files", with_views("postings_text") + """SELECT f.form, coalesce(id, '') AS id, coalesce(title, '') AS title,
  coalesce(nullif(company_name_en, ''), company_name_fa, '') AS company, CAST(length(left(coalesce(description, ''), 500)) AS BIGINT) AS n_description,
  coalesce(CAST(activation_time AS VARCHAR), '') AS posted_date, false AS remote
FROM postings_text, (VALUES ('parquet'), ('csv')) f(form)""")(_compact_files)
register("quarantine_sample", with_views("postings_text") + """SELECT id, title, CASE WHEN length(description) > 100
  THEN concat(left(description, 100), '...') ELSE description END AS description
FROM postings_text ORDER BY id LIMIT 5""")(
    lambda s, d: K.quarantine_sample(B.view(s, d, "postings_text").select("id", "title", "description"))[0])
register("quarantine_dump", W + "SELECT id, title FROM postings")(
    lambda s, d: K.quarantine_sample(P(s, d).select("id", "title", F.array("tags").alias("nested")))[1])


def _snapshot_restore(s, d):
    root = work_path(s, "backups")
    path = K.snapshot(U.with_audit_columns(P(s, d), "2024-01-31 00:00:00"), root, TS)
    table = work_path(s, "table", "restored")
    K.restore_snapshot(s, path, table, "2024-02-01 00:00:00")
    return EP.latest(s, table)


register("restore_snapshot", W + """SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS created_at,
  TIMESTAMP '2024-02-01 00:00:00' AS updated_at FROM postings""")(_snapshot_restore)


def _text_files(s, d):
    """The texts of ``documents`` as files, a hundred documents each."""
    path = work_path(s, "files", "texts")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t")))), lambda r: r["t"])
    B.table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 100)).agg(F.array_join(texts, "\n").alias("value")).select(
        "value").write.option("maxRecordsPerFile", 1).text(path)
    return path


_FILES_SQL = """SELECT sha256(t) AS sha256, CAST(octet_length(encode(t)) AS BIGINT) AS size
FROM (SELECT string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY doc_id // 100)"""


def _list_snapshots(s, d):
    root = work_path(s, "backups")
    K.snapshot(P(s, d), root, TS)
    K.snapshot(P(s, d), root, TS + _dt.timedelta(hours=1), files_root=_text_files(s, d))
    return K.list_snapshots(s, root).select(
        "name", "location", "metadata.backup_type", "metadata.files_included", "metadata.n_rows",
        # beside the texts the folder holds the success mark and its checksum files
        (F.col("metadata.file_bytes") > 0).alias("has_files"), (F.col("size_bytes") > F.col("metadata.file_bytes")).alias("sized"))


register("list_snapshots", W + """, n AS (SELECT count(*) AS n_rows FROM postings)
SELECT '20240201_000000' AS name, 'local' AS location, 'database_only' AS backup_type, false AS files_included, n_rows,
  false AS has_files, true AS sized FROM n
UNION ALL SELECT '20240201_010000', 'local', 'full', true, n_rows, true, true FROM n""")(_list_snapshots)


def _snapshot_files(s, d):
    """The text files after a snapshot and its restore, by their bytes."""
    path = K.snapshot(P(s, d).select("id"), work_path(s, "backups"), TS, files_root=_text_files(s, d))
    to = work_path(s, "files", "restored")
    K.restore_snapshot_files(s, path, to)
    return s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(to).select(
        F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


register("snapshot_files", _FILES_SQL)(_snapshot_files)


def _export_search(s, d):
    hits = B.view(s, d, "postings_text").where(R.search_filter(keyword="high", location="europe"))
    path = K.export_search(hits.select(*B.POSTING_COLUMNS), work_path(s, "export", "search.csv"), "csv")
    return RD.scan_csv(s, path, POSTINGS_SCHEMA, K.NULL_MARK)


register("export_search", with_views("postings_text") + """SELECT id, title, company_name_en, company_name_fa, company_id,
  activation_time, url, locations, work_types, tags, job_post_categories, salary, raw_data, batch_id FROM postings_text
WHERE (title ILIKE '%high%' OR description ILIKE '%high%') AND locations ILIKE '%europe%'""")(_export_search)


def _export_json(s, d):
    hits = P(s, d).where(FL.title_keyword("high"))
    path = K.export_search(hits, work_path(s, "export", "search.json"), "json")
    back = RD.scan_json_array(s, path, "id string, locations string, tags string, salary struct<min: long, max: long>", exact=False)
    text = RD.scan_json_array(s, path, "id string, salary string", exact=False).select("id", "salary")
    return back.select("id", F.json_array_length("locations").alias("n_locations"), F.json_array_length("tags").alias("n_tags"),
                       F.col("salary.min").alias("salary_min")).join(
        text.select("id", F.when(~F.col("salary").startswith("{"), F.col("salary")).alias("salary_text")), "id")


register("export_search_json", W + """SELECT id,
  CASE WHEN json_type(locations) = 'ARRAY' THEN CAST(json_array_length(locations) AS INTEGER) END AS n_locations,
  CASE WHEN json_type(tags) = 'ARRAY' THEN CAST(json_array_length(tags) AS INTEGER) END AS n_tags,
  CASE WHEN json_valid(salary) THEN CAST(json_extract(salary, '$.min') AS BIGINT) END AS salary_min,
  CASE WHEN NOT json_valid(salary) THEN salary END AS salary_text
FROM postings WHERE title ILIKE '%high%'""")(_export_json)


def _import(s, d, update_existing=True):
    """The counts of the import and the table after it."""
    table = work_path(s, "table", "jobs")
    EP.append(P(s, d), table, 1, "2024-01-31 00:00:00", reread=True)
    upload = B.view(s, d, "postings_v2").withColumn("id", F.when(~F.col("id").endswith("7"), F.col("id")))
    src = K.write_json(upload, work_path(s, "upload", "v2.json"))
    counts = K.import_postings(s, src, table, "2024-02-01 00:00:00", fmt="json", update_existing=update_existing,
                               schema=POSTINGS_SCHEMA)
    return counts, EP.latest(s, table)


# the upload lacks the ids that end in 7: those rows are errors
_IMPORT_SQL = with_views("postings_v2") + """SELECT 'success' AS status, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE id NOT LIKE '%7' AND id NOT IN (SELECT id FROM postings)) AS BIGINT) AS inserted,
  CAST(count(*) FILTER (WHERE id NOT LIKE '%7' AND id IN (SELECT id FROM postings)) AS BIGINT) {upd} AS updated,
  CAST(count(*) FILTER (WHERE id LIKE '%7') AS BIGINT) AS errors FROM postings_v2"""
register("import_postings", _IMPORT_SQL.replace("{upd}", ""))(lambda s, d: _import(s, d)[0])
register("import_insert_only", _IMPORT_SQL.replace("{upd}", "* 0"))(lambda s, d: _import(s, d, False)[0])

_STORED = """SELECT coalesce(n.id, o.id) AS id, CASE WHEN {new} THEN n.title ELSE o.title END AS title,
  CASE WHEN o.id IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-31' END AS created_at,
  CASE WHEN {new} THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-31' END AS updated_at
FROM postings o FULL OUTER JOIN (SELECT * FROM postings_v2 WHERE id NOT LIKE '%7') n ON n.id = o.id"""
for _name, _new, _update in (("import_stored", "n.id IS NOT NULL", True), ("import_stored_insert_only", "o.id IS NULL", False)):
    register(_name, with_views("postings_v2") + _STORED.replace("{new}", _new))(
        lambda s, d, update=_update: _import(s, d, update)[1].select("id", "title", "created_at", "updated_at"))
register("migrate_postings", W + """SELECT id AS source_id, coalesce(title, '') AS title,
  coalesce(company_name_en, '') AS company, coalesce(CASE WHEN json_type(locations) = 'ARRAY' THEN json_extract_string(locations, '$[0].city.titleEn') END, '') AS location,
  '' AS description, coalesce(url, '') AS url, 'USD' AS salary_currency, 'unknown' AS job_type,
  'unknown' AS source_website, coalesce(raw_data, '{}') AS metadata, true AS still_active FROM postings""")(
    lambda s, d: K.migrate_postings(P(s, d).select(
        "id", "title", F.col("company_name_en").alias("company"), D.primary_city().alias("location"), "url",
        F.col("raw_data").alias("metadata"))))
# Old tables: some jobs share a source, tag types share a name, and the bridge names jobs and tags that are gone.
_OLD_SQL = with_views("postings", "tags", "posting_tags") + """,
oj AS (SELECT id, title, coalesce(CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN concat('S', CAST(CAST(id AS BIGINT) // 4 AS VARCHAR)) END, id) AS source_id,
  CAST(id AS BIGINT) % 5 = 0 AS early FROM postings WHERE CAST(id AS BIGINT) % 9 <> 4),
ot AS (SELECT name AS id, split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 3) AS name FROM tags WHERE name NOT LIKE 'STANDARD%'),
jn AS (SELECT source_id, row_number() OVER (ORDER BY NOT early, source_id) AS number
  FROM (SELECT source_id, bool_or(early) AS early FROM oj GROUP BY 1)),
tn AS (SELECT name, row_number() OVER (ORDER BY name) AS number FROM (SELECT DISTINCT name FROM ot)),
br AS (SELECT b.posting_id AS job_id, b.tag_name AS tag_id, jn.number AS j, tn.number AS t FROM posting_tags b
  LEFT JOIN oj ON oj.id = b.posting_id LEFT JOIN jn ON jn.source_id = oj.source_id
  LEFT JOIN ot ON ot.id = b.tag_name LEFT JOIN tn ON tn.name = ot.name)
"""


def _migrate(s, d):
    """Two runs, the second over all rows: what the first numbered keeps its number."""
    n = F.col("id").cast("long")
    jobs = P(s, d).where(n % 9 != 4).select("id", "title", F.when(n % 7 == 0, F.concat(F.lit("S"), F.floor(n / 4).cast("string"))).alias("job_id"))
    tags = B.view(s, d, "tags").where(~F.col("name").startswith("STANDARD")).select(
        F.col("name").alias("id"), F.concat_ws(" ", F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(3))).alias("name"))
    bridge = B.view(s, d, "posting_tags").select(F.col("posting_id").alias("job_id"), F.col("tag_name").alias("tag_id"))
    root = work_path(s, "table", "numbers")
    K.migrate_tables(jobs.where(n % 5 == 0), tags, bridge, root)
    return K.migrate_tables(jobs, tags, bridge, root)


register("migrate_jobs", _OLD_SQL + """SELECT number AS id, source_id, arg_max(title, id) AS title
FROM oj JOIN jn USING (source_id) GROUP BY number, source_id""")(lambda s, d: _migrate(s, d)["jobs"].select("id", "source_id", "title"))
register("migrate_tags", _OLD_SQL + "SELECT number AS id, name, '' AS description FROM tn")(lambda s, d: _migrate(s, d)["tags"])
register("migrate_job_tags", _OLD_SQL + "SELECT DISTINCT j AS job_id, t AS tag_id FROM br WHERE j IS NOT NULL AND t IS NOT NULL")(
    lambda s, d: _migrate(s, d)["job_tags"])
register("migrate_orphans", _OLD_SQL + """SELECT DISTINCT job_id, tag_id, concat_ws(' ', CASE WHEN j IS NULL THEN 'job' END,
  CASE WHEN t IS NULL THEN 'tag' END) AS lacks FROM br WHERE j IS NULL OR t IS NULL""")(lambda s, d: _migrate(s, d)["orphans"])
register("read_legacy_table", _P_SQL)(lambda s, d: (P(s, d), RD.read_legacy_table(s, "postings"))[1])


# ---------------------------------------------------------------- files of any size, by lines


def _csv_records(s, d):
    path = work_path(s, "csv", "texts")
    docs = B.table(s, d, "documents").select("doc_id", "lang", "text")
    docs.write.options(header="true", quoteAll="true", escape='"', nullValue=K.NULL_MARK, emptyValue="", ignoreLeadingWhiteSpace="false",
                       ignoreTrailingWhiteSpace="false").csv(path)
    return RC.scan_csv_records(s, path, "doc_id long, lang string, text string", null_value=K.NULL_MARK)


def _json_records(s, d):
    """Pretty-printed arrays of 500 documents each."""
    path = work_path(s, "json", "arrays")
    one = F.to_json(F.struct("doc_id", "lang", "text"), {"pretty": "true"})
    arrays = B.table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 500)).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return RC.scan_json_records(s, path, "doc_id long, lang string, text string")


register("scan_csv_records", "SELECT doc_id, lang, coalesce(text, '') AS text FROM documents")(
    lambda s, d: _csv_records(s, d).withColumn("text", F.coalesce("text", F.lit(""))))
register("scan_json_records", "SELECT doc_id, lang, text FROM documents")(_json_records)
