"""Catalog: dedupe / windows / sets, joins, merge and audit, ledger and run
rollups (W01-W07, X01-X02, J01-J04, U01-U08, L01-L03, A16-A20, A22-A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derived as D
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import epochs as EP
from ..operators import merge as U
from ..operators import rows as RW
from ..operators import search as R
from ..session import work_path
from . import binding as B
from .oracle import with_views
from .registry import register

# Reproducible clocks for the merge tests: initial load and the second batch.
T0 = "2024-01-31 00:00:00"
T1 = "2024-02-01 00:00:00"


def V(s, d, name):
    return B.view(s, d, name)


_ARR_COLS = ("id, title, company_name_en, company_name_fa, company_id, activation_time, url, locations, "
             "work_types, tags, job_post_categories, salary, raw_data, batch_id, page, position")
WA = with_views("arrivals")

# ---------------------------------------------------------------- W01-W03
register("dedupe_first", WA + f"""SELECT {_ARR_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, position) AS rn FROM arrivals) t WHERE rn = 1""")(
    lambda s, d: RW.dedupe_first(V(s, d, "arrivals")))
register("dedupe_last", WA + f"""SELECT {_ARR_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY page DESC, position DESC) AS rn FROM arrivals
  WHERE id IS NOT NULL) t WHERE rn = 1""")(lambda s, d: RW.dedupe_last(V(s, d, "arrivals")))
register("dedupe_content", WA + f"""SELECT {_ARR_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY md5(concat_ws('-', coalesce(title, ''), coalesce(url, '')))
                               ORDER BY page, position) AS rn FROM arrivals) t WHERE rn = 1""")(
    lambda s, d: RW.dedupe_content(V(s, d, "arrivals")))
register("duplicate_count", WA + "SELECT CAST(count(*) - count(DISTINCT id) AS BIGINT) AS duplicates FROM arrivals")(
    lambda s, d: RW.duplicate_count(V(s, d, "arrivals")))

# ---------------------------------------------------------------- ledger state (L01) in DuckDB
_STATE = """
state AS (
  SELECT batch_id,
         arg_max(status, CASE WHEN status IS NOT NULL THEN event_seq END) AS status,
         arg_max(row_count, CASE WHEN row_count IS NOT NULL THEN event_seq END) AS row_count,
         arg_max(processing_time, CASE WHEN processing_time IS NOT NULL THEN event_seq END) AS processing_time,
         arg_max(error_message, CASE WHEN error_message IS NOT NULL THEN event_seq END) AS error_message,
         min(CASE WHEN status = 'processing' THEN event_time END) AS start_time,
         max(CASE WHEN status IN ('completed', 'failed') THEN event_time END) AS end_time,
         count(*) AS events
  FROM ledger_events GROUP BY batch_id)"""
WL = with_views("ledger_events").rstrip("\n") + "," + _STATE + "\n"


def STATE(s, d):
    return L.ledger_state(V(s, d, "ledger_events"))


register("batch_ledger", WL + "SELECT * FROM state")(lambda s, d: STATE(s, d))
register("record_run", WL + """SELECT batch_id AS run_id, coalesce(start_time, end_time) AS run_date,
  CAST(coalesce(row_count, 0) AS BIGINT) AS total_jobs, CAST(0 AS BIGINT) AS new_jobs, CAST(0 AS BIGINT) AS updated_jobs,
  CAST(status = 'failed' AS INTEGER) AS errors, coalesce(processing_time, 0.0) AS duration_seconds,
  coalesce(status, 'unknown') AS status FROM state""")(lambda s, d: L.record_run(STATE(s, d)))
register("run_history", WL + """SELECT batch_id AS run_id, start_time, end_time, row_count AS jobs_found, status,
  round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 3) AS duration_seconds FROM state""")(
    lambda s, d: L.run_history(STATE(s, d)))

# ---------------------------------------------------------------- W04-W07
register("retention", WL + """SELECT * FROM state
WHERE start_time >= (SELECT min(start_time) FROM (SELECT start_time FROM state ORDER BY start_time DESC NULLS LAST LIMIT 50) t)
   OR start_time >= (SELECT max(start_time) FROM state) - INTERVAL 7 DAY""")(
    lambda s, d: RW.retention(STATE(s, d), "start_time", 50, 7,
                              STATE(s, d).select(F.max("start_time")).scalar()))
register("running_mean", WL + """SELECT batch_id, status, round(CAST(s AS DOUBLE) / c * 100) / 10000 AS running_mean FROM (
  SELECT batch_id, status,
         sum(CAST(round(processing_time * 100) AS BIGINT)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
         count(processing_time) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM state) t""")(lambda s, d: _running_mean_cents(STATE(s, d)))


def _running_mean_cents(state):
    """W05 on the ledger: the mean is formed from integer cents, whose sums are
    exact, so both engines round the same quotient."""
    cents = F.round(F.col("processing_time") * 100).cast("long")
    out = RW.running_mean(state.select("batch_id", "status", cents.alias("cents")), "cents", ["batch_id"], "mean")
    return out.select("batch_id", "status", (F.round(F.col("mean") * 100) / 10000).alias("running_mean"))


register("failure_streak", WL + """, f AS (
  SELECT batch_id, status = 'failed' AS failed,
         sum(CAST(status = 'failed' AS BIGINT)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fails
  FROM state),
g AS (
  SELECT *, max(CASE WHEN NOT failed THEN fails ELSE 0 END) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_ok
  FROM f)
SELECT batch_id, CAST(CASE WHEN failed THEN fails - at_ok ELSE 0 END AS BIGINT) AS streak,
       CASE WHEN failed THEN fails - at_ok ELSE 0 END >= 2 AS alert FROM g""")(
    lambda s, d: RW.failure_streak(STATE(s, d).select("batch_id", "status"), F.col("status") == "failed",
                                   ["batch_id"], threshold=2).select("batch_id", "streak", "alert"))
_PL = with_views("page_log")
register("empty_page_stop", _PL + """SELECT page, ts, n_jobs, failed, has_next FROM page_log
WHERE page <= coalesce((SELECT min(page) FROM page_log WHERE n_jobs = 0 OR NOT has_next), 9223372036854775807)""")(
    lambda s, d: RW.empty_page_stop(V(s, d, "page_log"), n_postings="n_jobs"))
register("empty_page_stop_streak", _PL + """, f AS (
  SELECT *, sum(CAST(n_jobs = 0 AS BIGINT)) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM page_log),
g AS (
  SELECT *, max(CASE WHEN n_jobs <> 0 THEN e ELSE 0 END) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_ok
  FROM f)
SELECT page, ts, n_jobs, failed, has_next FROM g
WHERE page <= coalesce((SELECT min(page) FROM g WHERE n_jobs = 0 AND e - at_ok >= 3), 9223372036854775807)""")(
    lambda s, d: RW.empty_page_stop(V(s, d, "page_log"), n_postings="n_jobs", has_next=None, max_empty=3))

# ---------------------------------------------------------------- X01-X02
register("concat_batches", with_views("postings_v2") + """SELECT id, title, company_name_en, CAST(NULL AS VARCHAR) AS url FROM postings
UNION ALL SELECT id, title, NULL, url FROM postings_v2""")(
    lambda s, d: RW.concat_batches([V(s, d, "postings").select("id", "title", "company_name_en"),
                                    V(s, d, "postings_v2").select("id", "title", "url")]))
_codes = " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.TAG_CODES.items())
register("distinct_codes", with_views("postings") + f"""SELECT DISTINCT code FROM (
  SELECT unnest(CASE WHEN json_type(tags) = 'ARRAY' THEN list_distinct(list_transform(from_json(tags, '["VARCHAR"]'),
                                                                                    lambda t: CASE t {_codes} ELSE 0 END))
                     ELSE [0] END) AS code FROM postings) t""")(
    lambda s, d: RW.distinct_codes(V(s, d, "postings"), F.coalesce(
        F.transform(D.tags_array(), lambda t: F.coalesce(
            F.try_element_at(F.create_map(*[x for k, v in D.TAG_CODES.items() for x in (F.lit(k), F.lit(v))]), t),
            F.lit(0))), F.array(F.lit(0)))))

# ---------------------------------------------------------------- J01-J04
_WT = with_views("postings", "posting_tags", "tags")
register("postings_with_tags", _WT + """, per AS (
  SELECT b.posting_id, string_agg(DISTINCT b.tag_name, ',' ORDER BY b.tag_name) AS tag_names, count(DISTINCT b.tag_name) AS n_tags
  FROM posting_tags b JOIN tags t ON t.name = b.tag_name GROUP BY b.posting_id)
SELECT p.id, coalesce(per.tag_names, '') AS tag_names, coalesce(per.n_tags, 0) AS n_tags
FROM postings p LEFT JOIN per ON per.posting_id = p.id""")(
    lambda s, d: J.postings_with_tags(V(s, d, "postings"), V(s, d, "posting_tags"), V(s, d, "tags")).select(
        "id", F.array_join("tag_names", ",").alias("tag_names"), F.size("tag_names").cast("long").alias("n_tags")))
register("postings_of_tag", _WT + """SELECT id, title FROM postings
WHERE id IN (SELECT posting_id FROM posting_tags WHERE tag_name = 'PROMO')""")(
    lambda s, d: J.postings_of_tag(V(s, d, "postings"), V(s, d, "posting_tags"), "PROMO").select("id", "title"))
register("search_hits", with_views("postings", "searches", "search_results") + """SELECT s.search_id, s.query, r.job_id,
  p.title, r.found_date, r.relevance_score, r.line
FROM searches s JOIN search_results r ON s.search_id = r.search_id JOIN postings p ON r.job_id = p.id""")(
    lambda s, d: J.search_hits(V(s, d, "searches"), V(s, d, "search_results"), V(s, d, "postings")).select(
        "search_id", "query", "job_id", "title", "found_date", "relevance_score", "line"))
register("run_postings", WL.replace("WITH ", "WITH " + B.cte("postings")[5:].rstrip("\n") + ",\n", 1) + """SELECT p.id, p.batch_id, s.status, s.row_count
FROM postings p LEFT JOIN state s ON p.batch_id = concat('b', CAST(s.batch_id AS VARCHAR))""")(
    lambda s, d: J.run_postings(V(s, d, "postings"), STATE(s, d).select(
        F.concat(F.lit("b"), F.col("batch_id").cast("string")).alias("run_id"), "status", "row_count"))
    .select("id", "batch_id", "status", "row_count"))
register("has_tag", _WT + """SELECT id FROM postings p
WHERE EXISTS (SELECT 1 FROM posting_tags b WHERE b.posting_id = p.id AND b.tag_name LIKE '%M%')""")(
    lambda s, d: J.has_tag(V(s, d, "postings"), V(s, d, "posting_tags"), F.col("tag_name").like("%M%")).select("id"))

# ---------------------------------------------------------------- U01-U08
_W2 = with_views("postings_v2")
_PCOLS = ", ".join(B.POSTING_COLUMNS[1:])


def _target(s, d):
    return U.with_audit_columns(V(s, d, "postings"), T0)


_MERGE_SQL = _W2 + f"""SELECT coalesce(n.id, o.id) AS id,
  {", ".join(f"CASE WHEN n.id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in B.POSTING_COLUMNS[1:])},
  CASE WHEN o.id IS NOT NULL THEN TIMESTAMP '{T0}' ELSE TIMESTAMP '{T1}' END AS created_at,
  CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at
FROM postings o FULL OUTER JOIN postings_v2 n ON o.id = n.id"""
register("upsert", _MERGE_SQL)(lambda s, d: U.upsert(_target(s, d), V(s, d, "postings_v2"), T1))
# a batch with fewer columns (no url and so on) and one more
_PARTIAL = "id, title, length(title) AS title_chars"
register("upsert_partial", _W2 + f"""SELECT coalesce(n.id, o.id) AS id,
  CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title,
  {", ".join(f"o.{c}" for c in B.POSTING_COLUMNS[1:] if c != "title")}, n.title_chars,
  CASE WHEN o.id IS NOT NULL THEN TIMESTAMP '{T0}' ELSE TIMESTAMP '{T1}' END AS created_at,
  CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at
FROM postings o FULL OUTER JOIN (SELECT {_PARTIAL} FROM postings_v2) n ON o.id = n.id""")(
    lambda s, d: U.upsert(_target(s, d), V(s, d, "postings_v2").selectExpr(*_PARTIAL.split(", ")), T1))
# every id arrives twice; the smaller title comes last
register("upsert_last_arrival", _W2 + f"""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'a ' || n.title ELSE o.title END AS title,
  CASE WHEN n.id IS NOT NULL THEN 2 END AS arrival
FROM postings o FULL OUTER JOIN postings_v2 n ON o.id = n.id""")(
    lambda s, d: U.upsert(_target(s, d).select("id", "title", "created_at", "updated_at"), _twice(s, d), T1, order=["arrival"])
    .select("id", "title", "arrival"))


def _twice(s, d):
    v2 = V(s, d, "postings_v2").select("id", "title")
    return (v2.select("id", F.concat(F.lit("z "), "title").alias("title"), F.lit(1).alias("arrival"))
            .unionByName(v2.select("id", F.concat(F.lit("a "), "title").alias("title"), F.lit(2).alias("arrival"))))


register("upsert_counts", _W2 + """SELECT count(*) FILTER (WHERE o.id IS NULL) AS inserted,
  count(*) FILTER (WHERE o.id IS NOT NULL) AS updated
FROM (SELECT DISTINCT id FROM postings_v2) n LEFT JOIN postings o ON o.id = n.id""")(
    lambda s, d: U.upsert_counts(_target(s, d), V(s, d, "postings_v2")))
register("touch_updated_at", _W2 + f"""SELECT coalesce(n.id, o.id) AS id,
  CASE WHEN o.id IS NOT NULL THEN TIMESTAMP '{T0}' ELSE TIMESTAMP '{T1}' END AS created_at,
  CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at
FROM postings o FULL OUTER JOIN postings_v2 n ON o.id = n.id""")(
    lambda s, d: U.upsert(_target(s, d), V(s, d, "postings_v2"), T1).select("id", "created_at", "updated_at"))
register("insert_only", _W2 + f"""SELECT id, {_PCOLS}, TIMESTAMP '{T0}' AS created_at, TIMESTAMP '{T0}' AS updated_at FROM postings
UNION ALL
SELECT id, {_PCOLS}, TIMESTAMP '{T1}', TIMESTAMP '{T1}' FROM postings_v2 WHERE id NOT IN (SELECT id FROM postings)""")(
    lambda s, d: U.insert_only(_target(s, d), V(s, d, "postings_v2"), T1))
register("delete_by_id", with_views("postings") + f"""SELECT id, {_PCOLS}, TIMESTAMP '{T0}' AS created_at,
  TIMESTAMP '{T0}' AS updated_at FROM postings WHERE id NOT IN (SELECT id FROM postings WHERE batch_id = 'b3')""")(
    lambda s, d: U.delete_by_id(_target(s, d), V(s, d, "postings").where(F.col("batch_id") == "b3")))
_CHANGES = "SELECT id, title, CAST(NULL AS VARCHAR) AS url FROM postings_v2 WHERE title LIKE '%(updated)%'"
register("replace_or_patch", _W2 + f""", ch AS ({_CHANGES})
SELECT o.id, coalesce(ch.title, o.title) AS title, {", ".join(f"o.{c}" for c in B.POSTING_COLUMNS[2:6])},
  CASE WHEN ch.id IS NOT NULL THEN coalesce(ch.url, o.url) ELSE o.url END AS url,
  {", ".join(f"o.{c}" for c in B.POSTING_COLUMNS[7:])}, TIMESTAMP '{T0}' AS created_at,
  CASE WHEN ch.id IS NOT NULL THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at
FROM postings o LEFT JOIN ch ON ch.id = o.id""")(
    lambda s, d: U.replace_or_patch(_target(s, d), V(s, d, "postings_v2").where(F.col("title").like("%(updated)%"))
                                    .select("id", "title", F.lit(None).cast("string").alias("url")), T1, mode="patch"))
register("replace_put", _W2 + f""", ch AS ({_CHANGES})
SELECT o.id, o.title, {", ".join(f"o.{c}" for c in B.POSTING_COLUMNS[2:])}, TIMESTAMP '{T0}' AS created_at,
  TIMESTAMP '{T0}' AS updated_at
FROM postings o""")(
    lambda s, d: U.replace_or_patch(_target(s, d), V(s, d, "postings_v2").where(F.col("title").like("%(updated)%"))
                                    .select("id", "title", F.lit(None).cast("string").alias("url")), T1, mode="put"))

# complete rows replace, those without a URL (every second) are ignored
_PUT = "id, title, CASE WHEN CAST(id AS BIGINT) % 20 = 1 THEN 'https://new.example/' || id END AS url"
register("replace_put_complete", _W2 + f""", ch AS (SELECT {_PUT} FROM postings_v2 WHERE title LIKE '%(updated)%')
SELECT o.id, CASE WHEN ch.url IS NOT NULL THEN ch.title ELSE o.title END AS title, coalesce(ch.url, o.url) AS url,
  o.salary, TIMESTAMP '{T0}' AS created_at, CASE WHEN ch.url IS NOT NULL THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at
FROM postings o LEFT JOIN ch ON ch.id = o.id""")(
    lambda s, d: U.replace_or_patch(_target(s, d), V(s, d, "postings_v2").where(F.col("title").like("%(updated)%"))
                                    .selectExpr("id", "title", _PUT.split(", ", 2)[2]), T1, mode="put")
    .select("id", "title", "url", "salary", "created_at", "updated_at"))


def _j(alias):
    inner = ", ".join(f"'{c}', CAST({alias}.{c} AS VARCHAR)" for c in B.POSTING_COLUMNS)
    return f"CAST(json_object({inner}) AS VARCHAR)"


_SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in B.POSTING_COLUMNS)
register("audit_feed", _W2 + f"""SELECT 'jobs' AS table_name, coalesce(n.id, o.id) AS record_id,
  CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action,
  CASE WHEN o.id IS NOT NULL THEN {_j('o')} END AS old_data,
  CASE WHEN n.id IS NOT NULL THEN {_j('n')} END AS new_data,
  'system' AS changed_by, TIMESTAMP '{T1}' AS changed_at
FROM postings o FULL OUTER JOIN postings_v2 n ON o.id = n.id
WHERE NOT (o.id IS NOT NULL AND n.id IS NOT NULL AND {_SAME})""")(
    lambda s, d: U.audit_feed(V(s, d, "postings"), V(s, d, "postings_v2"), T1))
register("natural_key_conflicts", with_views("postings") + """SELECT company_id, title, count(*) AS n FROM postings
GROUP BY company_id, title HAVING count(*) > 1""")(
    lambda s, d: U.natural_key_conflicts(V(s, d, "postings"), ["company_id", "title"]))

# ---------------------------------------------------------------- A16-A20, A22-A24
register("run_statistics", _PL + """, a AS (
  SELECT count(*) AS pages, CAST(sum(n_jobs) AS BIGINT) AS jobs, count(*) FILTER (WHERE failed) AS failed_pages,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS rt FROM page_log),
ff AS (SELECT string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS first_failed_pages
       FROM (SELECT page FROM page_log WHERE failed ORDER BY page LIMIT 10) t)
SELECT pages, jobs, failed_pages, round(rt, 2) AS runtime_seconds, round(jobs / greatest(1, pages), 2) AS jobs_per_page,
  round(jobs / greatest(1.0, rt), 2) AS jobs_per_second, round(failed_pages * 100.0 / greatest(1, pages), 2) AS failed_pct,
  coalesce(first_failed_pages, '') AS first_failed_pages FROM a, ff""")(
    lambda s, d: L.run_statistics(V(s, d, "page_log")))
register("run_log_rollup", WL + """SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS successes,
  count(*) FILTER (WHERE status = 'failed') AS failures, arg_max(status, (start_time, batch_id)) AS last_status,
  max(start_time) AS last_time, arg_max(processing_time, (start_time, batch_id)) AS last_duration,
  arg_max(error_message, CASE WHEN status = 'failed' THEN (start_time, batch_id) END) AS last_error,
  CAST(sum(row_count) AS BIGINT) AS total_collected FROM state""")(lambda s, d: L.run_log_rollup(STATE(s, d)))
register("batch_rollup", WL + """SELECT count(*) AS batches, CAST(sum(CASE WHEN status = 'completed' THEN row_count END) AS BIGINT) AS rows,
  count(*) FILTER (WHERE status = 'failed') AS failures, round(avg(processing_time), 4) AS mean_batch_time FROM state""")(
    lambda s, d: L.batch_rollup(STATE(s, d)))
register("errors_by_type", with_views("errors") + "SELECT error_type, count(*) AS n FROM errors GROUP BY error_type")(
    lambda s, d: A.errors_by_type(V(s, d, "errors")))
register("error_rate", """SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS requests,
  round(count(*) FILTER (WHERE event_type = 'error') / (count(*) + 1), 6) AS error_rate FROM events""")(
    lambda s, d: A.error_rate(B.table(s, d, "events"), F.col("event_type") == "error"))


def _hist_sql(value: str, src: str, bounds) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE {value} <= {float(b)}) AS le_{str(b).replace('.', '_')}" for b in bounds)
    return f"SELECT {cols}, count({value}) AS le_inf, round(sum({value}), 2) AS sum FROM {src}"


register("duration_histogram", WL + _hist_sql("processing_time", "state", A.SCRAPE_BOUNDS))(
    lambda s, d: A.duration_histogram(STATE(s, d), "processing_time", A.SCRAPE_BOUNDS))
register("db_duration_histogram", _hist_sql("v", "(SELECT value / 100 AS v FROM events) t", A.DB_BOUNDS))(
    lambda s, d: A.duration_histogram(B.table(s, d, "events").select((F.col("value") / 100).alias("v")), "v",
                                      A.DB_BOUNDS))
register("next_sequence", "SELECT CAST(coalesce(max(event_id), 0) + 1 AS BIGINT) AS next_id FROM events")(
    lambda s, d: A.next_sequence(B.table(s, d, "events"), "event_id"))
register("ingest_counters", with_views("ledger_events") + """SELECT status, CAST(count(*) AS BIGINT) AS total
FROM ledger_events GROUP BY status""")(lambda s, d: A.ingest_counters(V(s, d, "ledger_events"), ["status"]))
register("ingest_counters_rows", with_views("ledger_events") + """SELECT status, CAST(sum(row_count) AS BIGINT) AS total
FROM ledger_events GROUP BY status""")(
    lambda s, d: A.ingest_counters(V(s, d, "ledger_events"), ["status"], "row_count"))

# ---------------------------------------------------------------- R06, A28
register("recent_batches", WL + """SELECT * FROM state ORDER BY start_time DESC NULLS LAST, batch_id DESC LIMIT 20""")(
    lambda s, d: R.recent_batches(STATE(s, d), 20))
register("custom_sql", with_views("postings") + """SELECT batch_id, count(*) AS n FROM postings
WHERE title ILIKE '%high%' GROUP BY batch_id""")(
    lambda s, d: A.custom_sql(s, {"jobs": V(s, d, "postings")},
                              "SELECT batch_id, count(*) AS n FROM jobs WHERE title ILIKE :kw GROUP BY batch_id",
                              {"kw": "%high%"}))

# ---------------------------------------------------------------- U07 on a table of epochs

def _table_changes(s, d):
    table = work_path(s, "table", "audited")
    EP.append(V(s, d, "postings"), table, 1, T0)
    EP.append(V(s, d, "postings_v2"), table, 2, T1)
    return EP.changes(s, table, 1, 2, T1)


_NEW = ", ".join(f"CASE WHEN n.id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in B.POSTING_COLUMNS[1:])
register("table_changes", _W2 + f""", merged AS (
  SELECT coalesce(n.id, o.id) AS id, {_NEW} FROM postings o FULL OUTER JOIN postings_v2 n ON o.id = n.id)
SELECT 'jobs' AS table_name, coalesce(n.id, o.id) AS record_id,
  CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action,
  CASE WHEN o.id IS NOT NULL THEN {_j('o')} END AS old_data,
  CASE WHEN n.id IS NOT NULL THEN {_j('n')} END AS new_data,
  'system' AS changed_by, TIMESTAMP '{T1}' AS changed_at
FROM postings o FULL OUTER JOIN merged n ON o.id = n.id
WHERE NOT (o.id IS NOT NULL AND n.id IS NOT NULL AND {_SAME})""")(_table_changes)
