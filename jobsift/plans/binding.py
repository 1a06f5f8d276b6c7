"""Fixture binding: the shared test tables seen as postings data.

The test data has no job postings, so the postings table and its side
tables are *derived* from the TPC-H-like tables by SQL texts that both Spark
and DuckDB accept unchanged (see FIXTURES.md).  The same texts feed the
Spark queries (as temp views) and the DuckDB oracle (as CTEs), so both sides
start from identical inputs; everything after the binding is independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# --- fixed values: the binding specification of FIXTURES.md §3 ----------
POSTINGS_SQL = """
SELECT CAST(o.o_orderkey AS VARCHAR(20)) AS id,
       concat(o.o_orderpriority, ' ', c.c_mktsegment) AS title,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL WHEN c.c_custkey % 10 = 1 THEN '' ELSE c.c_name END AS company_name_en,
       CASE WHEN c.c_custkey % 20 = 0 THEN NULL ELSE concat('FA ', c.c_name) END AS company_name_fa,
       CAST(c.c_custkey AS VARCHAR(20)) AS company_id,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderdate END AS activation_time,
       concat('example.org/p/', CAST(o.o_orderkey AS VARCHAR(20))) AS url,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
            WHEN o.o_orderkey % 13 = 1 THEN '[]'
            WHEN o.o_orderkey % 13 = 2 THEN '{"bad":1}'
            ELSE concat('[{"province":{"id":', CAST(r.r_regionkey AS VARCHAR(20)), ',"name":"', r.r_name,
                        '"},"city":{"id":', CAST(100 + n.n_nationkey AS VARCHAR(20)), ',"titleEn":"', n.n_name, '"}}]') END AS locations,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            ELSE concat('[{"titleEn":"', CASE WHEN o.o_orderkey % 3 = 0 THEN 'Full time' WHEN o.o_orderkey % 3 = 1 THEN 'Part time' ELSE 'Contract' END, '"}]') END AS work_types,
       CASE o.o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["دورکاری"]'
            WHEN 3 THEN '["پاره وقت","کارآموزی"]' WHEN 4 THEN '["بدون نیاز به سابقه","other"]' ELSE '["امریه سربازی",null]' END AS tags,
       CASE o.o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]'
            WHEN 2 THEN concat('[{"titleEn":"', c.c_mktsegment, '"}]')
            ELSE concat('[{"titleEn":"', r.r_name, '"},{"titleEn":"', c.c_mktsegment, '"}]') END AS job_post_categories,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'negotiable'
            ELSE concat('{"min":', CAST(CAST(floor(o.o_totalprice / 2) AS BIGINT) AS VARCHAR(20)), ',"max":', CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR(20)), '}') END AS salary,
       CASE WHEN o.o_orderkey % 9 = 0 THEN '{}'
            ELSE concat('{"jobBoard":{"titleEn":"Board ', CAST(o.o_orderkey % 7 AS VARCHAR(20)), '","titleFa":"FA ', CAST(o.o_orderkey % 7 AS VARCHAR(20)), '"}}') END AS raw_data,
       concat('b', CAST(o.o_orderkey % 20 AS VARCHAR(20))) AS batch_id
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

POSTING_COLUMNS = ("id", "title", "company_name_en", "company_name_fa", "company_id",
                   "activation_time", "url", "locations", "work_types", "tags",
                   "job_post_categories", "salary", "raw_data", "batch_id")

# Tag dimension and posting-tag bridge.
TAGS_SQL = "SELECT DISTINCT p_type AS name FROM part"
POSTING_TAGS_SQL = """
SELECT DISTINCT CAST(l.l_orderkey AS VARCHAR(20)) AS posting_id, p.p_type AS tag_name
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

# Batch ledger events: four events per batch; event 0 starts it, event 3 ends it.
LEDGER_EVENTS_SQL = """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS batch_id,
       event_id AS event_seq,
       ts AS event_time,
       CASE WHEN event_id % 4 = 0 THEN 'processing'
            WHEN event_id % 4 = 3 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END
       END AS status,
       CASE WHEN event_id % 4 = 0 THEN user_id END AS row_count,
       CASE WHEN event_id % 4 = 3 THEN value END AS processing_time,
       CASE WHEN event_id % 4 = 3 AND event_type = 'error' THEN props END AS error_message
FROM events
"""

# A quarter of the errors come together at the start of their day: bursts, so that alert rules see both outcomes.
ERRORS_SQL = """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) END AS ts,
       concat('type', CAST(user_id % 3 AS STRING)) AS error_type, value, props
FROM events WHERE event_type = 'error'
"""

# Signups of three days of each ten come three days earlier: gaps in which the absence alert holds, with every signup kept.
SIGNUPS_SQL = """
SELECT event_id, CASE WHEN extract(DAY FROM ts) % 10 IN (4, 5, 6) THEN ts - INTERVAL 3 DAY ELSE ts END AS ts, user_id, value
FROM events WHERE event_type = 'signup'
"""

# Second version of the postings for merge / audit: every tenth id removed,
# ids ending in 1 retitled, the removed rows re-appearing under new ids.
_REST = "company_name_en, company_name_fa, company_id, activation_time, url, locations, work_types, tags, job_post_categories, salary, raw_data, batch_id"
POSTINGS_V2_SQL = f"""
SELECT id,
       CASE WHEN CAST(id AS BIGINT) % 10 = 1 THEN concat(title, ' (updated)') ELSE title END AS title,
       {_REST}
FROM postings WHERE CAST(id AS BIGINT) % 10 <> 0
UNION ALL
SELECT CAST(CAST(id AS BIGINT) + 10000000 AS STRING) AS id, title, {_REST}
FROM postings WHERE CAST(id AS BIGINT) % 10 = 0
"""

# Arrival stream with duplicates: page 0 is the view itself, page 1 a copy
# whose ids are shifted by one, so every id arrives twice with different
# content and every (title, url) pair arrives twice under different ids.
ARRIVALS_SQL = f"""
SELECT id, title, {_REST}, 0 AS page, CAST(id AS BIGINT) AS position FROM postings
UNION ALL
SELECT CAST(CAST(id AS BIGINT) + 1 AS STRING) AS id, title, {_REST}, 1 AS page, CAST(id AS BIGINT) AS position
FROM postings
"""

# Description text joined from documents.
POSTINGS_TEXT_SQL = """
SELECT p.*, d.text AS description
FROM postings p LEFT JOIN documents d ON d.doc_id = CAST(p.id AS BIGINT)
"""
# Timestamp texts in every shape the parsers meet, built from events.ts:
# ISO with fraction + Z, ISO + Z, space-separated, date only, ISO minutes, garbage.
TS_TEXTS_SQL = """
SELECT event_id,
       CASE event_id % 6
            WHEN 0 THEN concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z')
            WHEN 1 THEN concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), 'Z')
            WHEN 2 THEN substr(CAST(ts AS STRING), 1, 19)
            WHEN 3 THEN substr(CAST(ts AS STRING), 1, 10)
            WHEN 4 THEN replace(substr(CAST(ts AS STRING), 1, 16), ' ', 'T')
            ELSE concat('week ', CAST(event_id AS STRING)) END AS ts_text
FROM events
"""
# Saved searches and their hits: one search per part brand; a hit per line
# item (posting = its order, found on the ship date, score = discount).
SEARCHES_SQL = """
SELECT DISTINCT p_brand AS search_id, concat('brand ', p_brand) AS query FROM part
"""
SEARCH_RESULTS_SQL = """
SELECT p.p_brand AS search_id, CAST(l.l_orderkey AS VARCHAR(20)) AS job_id, l.l_shipdate AS found_date,
       l.l_discount AS relevance_score, l.l_linenumber AS line
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""
# Page fetch log for run statistics and stop rules: one event = one page.
PAGE_LOG_SQL = """
SELECT event_id AS page, ts,
       CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE user_id END AS n_jobs,
       event_type = 'error' AS failed,
       event_type <> 'signup' AS has_next
FROM events
"""
# Pages by source, with empty, last and failed ones, for the stop rule on a stream.
SOURCE_PAGES_SQL = """
SELECT concat('s', CAST(user_id % 40 AS STRING)) AS source, event_id AS page, ts,
       CASE WHEN event_id % 13 = 0 OR (user_id % 4 = 0 AND event_id % 100 >= 50) THEN 0 ELSE user_id % 50 + 1 END AS n_postings,
       event_id % 61 <> 60 AS has_next, event_type = 'error' OR user_id % 5 = 2 AS failed
FROM events
"""
# New postings by source, sparse enough for days without any.
SOURCE_NEW_SQL = "SELECT concat('s', CAST(user_id % 60 AS STRING)) AS source, ts, event_id FROM events WHERE event_type = 'signup' AND event_id % 3 = 0"
# --- end of fixed values --------------------------------------------------

DERIVED_VIEWS = {
    "postings": POSTINGS_SQL,
    "tags": TAGS_SQL,
    "posting_tags": POSTING_TAGS_SQL,
    "ledger_events": LEDGER_EVENTS_SQL,
    "errors": ERRORS_SQL,
    "signups": SIGNUPS_SQL,
    "postings_v2": POSTINGS_V2_SQL,
    "arrivals": ARRIVALS_SQL,
    "postings_text": POSTINGS_TEXT_SQL,
    "ts_texts": TS_TEXTS_SQL,
    "searches": SEARCHES_SQL,
    "search_results": SEARCH_RESULTS_SQL,
    "page_log": PAGE_LOG_SQL,
    "source_pages": SOURCE_PAGES_SQL,
    "source_new": SOURCE_NEW_SQL,
}

# Which derived views each view reads (to build CTE chains for the oracle).
_DEPENDS = {
    "postings_v2": ("postings",),
    "arrivals": ("postings",),
    "postings_text": ("postings",),
}


def register_base(spark: SparkSession, sf_dir: str) -> None:
    """Expose the test tables of one scale as temp views."""
    prepare(spark)
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Register the base tables and return one derived view as a DataFrame."""
    register_base(spark, sf_dir)
    for dep in _DEPENDS.get(name, ()):
        spark.sql(DERIVED_VIEWS[dep]).createOrReplaceTempView(dep)
    df = spark.sql(DERIVED_VIEWS[name])
    df.createOrReplaceTempView(name)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "postings")


def cte(*names: str) -> str:
    """``WITH`` clause defining the named derived views (oracle side)."""
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, ()):
            if dep not in order:
                order.append(dep)
        if n not in order:
            order.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED_VIEWS[n]})" for n in order) + "\n"
