"""Catalog: streaming ingestion, alert windows, health, throughput, HTML
extraction (S09, S13, T01-T09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import epochs as EP
from ..operators import ledger as L
from ..session import shuffles_removed, work_path
from ..sources import api as API
from ..sources import html as H
from ..sources import listings as LI
from ..streaming import alerts as T
from ..streaming import ingest as I
from ..streaming import resume as RE
from ..streaming import state as ST
from . import binding as B
from .oracle import with_views
from .registry import register


def _records(postings, page_size=50):
    """API records of postings, built by all tasks however few files the tables have."""
    return API.dealt_records(postings, page_size)


def _landed(s, postings, path, page_size, first_page=0):
    """The postings' pages as compressed JSON lines; their numbers begin at ``first_page``."""
    with shuffles_removed(s):
        pages = API.posting_pages(postings, page_size, _records(postings, page_size)).withColumn("page", F.col("page") + F.lit(first_page))
        pages.write.mode("append").option("compression", "gzip").json(path)
    return path


def _land(s, d, page_size=50):
    return _landed(s, B.postings(s, d), work_path(s, "landing", "pages"), page_size)


def _stream_pages(s, d):
    landing = _land(s, d, page_size=1000)
    out = work_path(s, "sink", "pages")
    I.run_to_parquet(I.stream_pages(s, landing, max_files_per_trigger=2), out, work_path(s, "ckpt", "pages"))
    return s.read.parquet(out).select("id", "title", "page")


register("stream_pages", with_views("postings") + "SELECT id, title, CAST(id AS BIGINT) // 1000 AS page FROM postings")(
    _stream_pages)

# Stored is what passes the cleaning rules (a list of locations), with a scheme before the URL and
# salaries as JSON text; the second landing wins over the first.
_TABLE_SQL = with_views("postings", "postings_v2") + """SELECT id, title, 'https://' || url AS url, company_id,
  trim(company_name_en) AS company_name_en, trim(company_name_fa) AS company_name_fa, activation_time,
  CASE WHEN json_valid(salary) THEN salary ELSE CAST(json_object('raw', salary) AS VARCHAR) END AS salary
FROM (SELECT * FROM postings_v2 UNION ALL
      SELECT * FROM postings WHERE id NOT IN (SELECT id FROM postings_v2))
WHERE json_type(locations) = 'ARRAY' AND json_array_length(locations) > 0"""


def _land_later(s, d, path):
    """A second landing: postings_v2 on later pages, and two lines that are no pages."""
    _landed(s, B.view(s, d, "postings_v2"), path, 1000, first_page=1 << 40)
    (s.range(2).select(F.format_string('{"page": %d, "data": {"jobPosts": [', "id").alias("value"))
     .write.mode("append").text(path))


def _ingest(s, d, runs: int):
    """One run over both landings (each changed posting arrives twice in a batch), or a run after each from the same checkpoint."""
    landing = _land(s, d, page_size=1000)
    table, ledger, ckpt = work_path(s, "table", "jobs"), work_path(s, "ledger"), work_path(s, "ckpt", "ingest")
    if runs == 2:
        I.stream_ingest(s, landing, table, ckpt, ledger, max_files_per_trigger=1000)
    _land_later(s, d, landing)
    I.stream_ingest(s, landing, table, ckpt, ledger, max_files_per_trigger=1000)
    return table, ledger


def _stored(s, table):
    return EP.latest(s, table).select("id", "title", "url", "company_id", "company_name_en", "company_name_fa",
                                      "activation_time", "salary")


register("stream_ingest", _TABLE_SQL)(lambda s, d: _stored(s, _ingest(s, d, 1)[0]))
register("resume_state", _TABLE_SQL)(
    lambda s, d: _stored(s, EP.rewrite(s, _ingest(s, d, 2)[0], work_path(s, "table", "folded"))))
register("stream_ledger", with_views("postings") + """SELECT CAST(0 AS BIGINT) AS batch_id, 'completed' AS status,
  CAST(count(*) FILTER (WHERE json_type(locations) = 'ARRAY' AND json_array_length(locations) > 0) AS BIGINT) AS row_count,
  CAST(0 AS BIGINT) AS malformed_pages,
  CAST(count(*) FILTER (WHERE NOT coalesce(json_type(locations) = 'ARRAY' AND json_array_length(locations) > 0, false)) AS BIGINT)
    AS invalid_rows FROM postings UNION ALL
SELECT 1, 'completed', (SELECT count(*) FROM postings WHERE json_type(locations) = 'ARRAY' AND json_array_length(locations) > 0), 2,
  (SELECT count(*) FROM postings WHERE NOT coalesce(json_type(locations) = 'ARRAY' AND json_array_length(locations) > 0, false))""")(
    lambda s, d: L.ledger_state(I.ledger(s, _ingest(s, d, 2)[1]), cols=("status", "row_count", "malformed_pages", "invalid_rows"))
    .select("batch_id", "status", "row_count", "malformed_pages", "invalid_rows"))


def _dedupe(s, d):
    src = work_path(s, "landing", "arrivals")
    arr = B.view(s, d, "arrivals").select(
        "id", F.coalesce("activation_time", F.lit("1995-01-01").cast("timestamp_ntz")).cast("timestamp").alias("ts"))
    arr.repartition(4).write.parquet(src)
    stream = s.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    out = work_path(s, "sink", "dedupe")
    I.run_to_parquet(I.stream_dedupe(stream, "id", "ts", "10000 days"), out, work_path(s, "ckpt", "dedupe"))
    return s.read.parquet(out).select("id")


register("stream_dedupe", with_views("arrivals") + "SELECT DISTINCT id FROM arrivals")(_dedupe)


def _arrivals_in_order(s, d):
    """Arrivals in four files by arrival order: page 1 brings each id again, long after its state is gone,
    and every seventh row of it is a new id that is far behind the watermark."""
    src = work_path(s, "landing", "arrivals")
    day = F.make_dt_interval(F.col("position") % 40 + 60 * F.col("page"))
    arr = B.view(s, d, "arrivals")
    behind = (F.col("page") == 1) & (F.col("position") % 7 == 0)
    arr = arr.select(F.when(behind, F.concat(F.lit("late"), "id")).otherwise(F.col("id")).alias("id"), "page",
                     F.when(behind, F.lit("2020-01-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp") + day).alias("ts"),
                     (F.col("page") * 2 + F.col("position") % 2).alias("part"))
    for part in range(4):  # all tasks make the rows, one writes the two columns
        arr.where(F.col("part") == part).select("id", "ts").repartition(1).write.mode("append").parquet(src)
    return src


def _dedupe_exact(s, d):
    src = _arrivals_in_order(s, d)
    stream = s.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    table, late = work_path(s, "table", "unique"), work_path(s, "table", "late")
    I.stream_dedupe_exact(stream, table, work_path(s, "ckpt", "unique"), delay="7 days", late=late)
    I.settle_late(s.read.parquet(src), table, late)
    kinds = [EP.read(s, root).select("id", F.lit(kind).alias("kind")) for root, kind in ((table, "in time"), (late, "late"))]
    return kinds[0].unionByName(kinds[1])


register("stream_dedupe_exact", with_views("arrivals") + """SELECT DISTINCT
  CASE WHEN page = 1 AND position % 7 = 0 THEN concat('late', id) ELSE id END AS id,
  CASE WHEN page = 1 AND position % 7 = 0 THEN 'late' ELSE 'in time' END AS kind FROM arrivals""")(_dedupe_exact)


_RESUME_AT = ("2024-01-03 06:00:00", "2024-01-20 00:00:00", "2024-12-31 00:00:00")


def _resume(s, d):
    """Three restarts: early, in the middle, and long after the last page."""
    index = B.view(s, d, "source_pages").withColumnRenamed("ts", "arrival")
    runs = []
    for now in _RESUME_AT:
        plan = RE.resume_plan(index, now)
        again = RE.pages_to_replay(index, plan, now).groupBy("source").agg(F.count(F.lit(1)).alias("n_replayed"))
        runs.append(plan.join(again, "source").withColumn("run_at", F.lit(now)))
    return reduce(DataFrame.unionByName, runs)


register("resume_plan", with_views("source_pages") + " UNION ALL ".join(f"""SELECT source, last_page, last_updated, resumed, first_page,
  (SELECT count(*) FROM source_pages q WHERE q.source = t.source AND q.ts <= TIMESTAMP '{at}' AND q.page >= t.first_page) AS n_replayed, '{at}' AS run_at
FROM (SELECT source, max(page) AS last_page, max(ts) AS last_updated, max(ts) >= TIMESTAMP '{at}' - INTERVAL 24 HOUR AS resumed,
        CASE WHEN max(ts) >= TIMESTAMP '{at}' - INTERVAL 24 HOUR THEN greatest(max(page) - 5, 1) ELSE 1 END AS first_page
      FROM source_pages WHERE ts <= TIMESTAMP '{at}' GROUP BY source) t""" for at in _RESUME_AT))(_resume)


def _win_sql(length_min: int, slide_min: int) -> str:
    k = length_min // slide_min
    return f"""SELECT ws AS window_start, ws + INTERVAL {length_min} MINUTE AS window_end, count(*) AS errors
FROM (SELECT time_bucket(INTERVAL {slide_min} MINUTE, ts) - INTERVAL (r.k * {slide_min}) MINUTE AS ws
      FROM errors, range({k}) r(k)) t GROUP BY ws"""


_WE = with_views("errors")
register("errors_5m", _WE + f"SELECT *, errors > 5 AS unhealthy FROM ({_win_sql(5, 1)}) w")(
    lambda s, d: T.errors_5m(B.view(s, d, "errors")))
register("errors_1h", _WE + f""", w AS ({_win_sql(60, 10)})
SELECT c.window_start, c.window_end, c.errors, c.errors > 10 AND coalesce(p.errors, 0) > 10 AS alert
FROM w c LEFT JOIN w p ON p.window_start + INTERVAL 10 MINUTE = c.window_start""")(
    lambda s, d: T.errors_1h(B.view(s, d, "errors")))
register("error_burst", _WE + f"SELECT *, errors > 10 AS burst FROM ({_win_sql(1, 1)}) w")(
    lambda s, d: T.error_burst(B.view(s, d, "errors")))

_NO_NEW = """, c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM signups GROUP BY 1),
cal AS (SELECT h AS hour FROM range((SELECT min(hour) FROM c), (SELECT max(hour) FROM c) + INTERVAL 1 HOUR, INTERVAL 1 HOUR) t(h)),
per AS (SELECT cal.hour, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM cal LEFT JOIN c ON c.hour = cal.hour),
r AS (SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM per)
SELECT hour, n, recent, recent = 0 AND coalesce(lag(recent) OVER (ORDER BY hour), 1) = 0 AS alert FROM r"""
register("no_new_24h", with_views("signups") + _NO_NEW)(lambda s, d: T.no_new_24h(B.view(s, d, "signups")))
register("health_status", with_views("errors", "signups") + _NO_NEW.replace(
    "SELECT hour, n, recent, recent = 0", ", stale AS (SELECT hour, recent = 0", 1).replace(
    "AS alert FROM r", "AS alert FROM r)", 1) + f""", e AS (SELECT *, errors > 5 AS unhealthy FROM ({_win_sql(5, 1)}) w)
SELECT e.window_start, e.window_end, e.errors,
  CASE WHEN e.unhealthy THEN 'unhealthy' WHEN coalesce(stale.alert, false) THEN 'degraded' ELSE 'healthy' END AS status
FROM e LEFT JOIN stale ON stale.hour = date_trunc('hour', e.window_end)""")(
    lambda s, d: T.health_status(T.errors_5m(B.view(s, d, "errors")), T.no_new_24h(B.view(s, d, "signups"))))

_STATE = """, state AS (
  SELECT batch_id, arg_max(row_count, CASE WHEN row_count IS NOT NULL THEN event_seq END) AS row_count,
         arg_max(processing_time, CASE WHEN processing_time IS NOT NULL THEN event_seq END) AS processing_time
  FROM ledger_events GROUP BY batch_id)"""
register("batch_throughput", with_views("ledger_events").rstrip("\n") + _STATE + """
SELECT batch_id, row_count, processing_time,
  round(CASE WHEN processing_time = 0 THEN NULL ELSE row_count / processing_time END, 3) AS rows_per_second FROM state""")(
    lambda s, d: T.batch_throughput(L.ledger_state(B.view(s, d, "ledger_events"))))

# ---------------------------------------------------------------- S13


def _unesc(x: str) -> str:
    out = x
    for ent, ch in H.ENTITIES:
        out = f"replace({out}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return out


def _strip(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


register("extract_listings", f"""SELECT page_id, url,
  {_unesc("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title,
  {_unesc(_strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))} AS heading,
  CAST(len(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS BIGINT) AS n_links,
  regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)[1] AS first_link,
  CAST(len(regexp_extract_all(html, '(?is)<p[\\s>]')) AS BIGINT) AS n_paragraphs,
  CAST(length({_unesc(_strip("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"))}) AS BIGINT) AS text_chars
FROM pages""")(lambda s, d: H.extract_listings(B.table(s, d, "pages")))
register("extract_links", """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, l[i] AS href
FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages) t,
     range(1, len(l) + 1) r(i)""")(lambda s, d: H.extract_links(B.table(s, d, "pages")))

#: Navigation entries are listings with a title and a link; paragraphs and advertisements have a description alone.
LISTINGS = {"nav": LI.Selectors(job_list="nav", item="li", title="a", url="a[href]"),
            "article": LI.Selectors(job_list="article", item="p", description=":scope"),
            "ad": LI.Selectors(item="div.ad", description=":scope")}


_HREF = "regexp_extract(x, 'href=\"([^\"]*)\"', 1)"


def _listing_items(s, d):
    found = [LI.extract_listing_items(B.table(s, d, "pages"), sel).select(F.lit(kind).alias("kind"), "*") for kind, sel in LISTINGS.items()]
    return reduce(DataFrame.unionByName, found)


register("extract_listing_items", f"""WITH li AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), '(?is)<li>(.*?)</li>', 1) AS l FROM pages),
p AS (SELECT page_id, string_split_regex(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<p[^>]*>')[2:] AS l FROM pages),
ad AS (SELECT page_id, regexp_extract_all(html, '(?is)<div class="ad">(.*?)</div>', 1) AS l FROM pages),
r AS (SELECT 'nav' AS kind, page_id, unnest(range(len(l))) AS position, unnest(l) AS x FROM li UNION ALL
      SELECT 'article', page_id, unnest(range(len(l))), unnest(list_transform(l, lambda x: string_split(x, '</p>')[1])) FROM p UNION ALL
      SELECT 'ad', page_id, unnest(range(len(l))), unnest(l) FROM ad)
SELECT kind, page_id, CAST(position AS INTEGER) AS position, CASE WHEN kind = 'nav' THEN {_unesc(_strip("x"))} END AS title,
  CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS location, CASE WHEN kind <> 'nav' THEN {_unesc(_strip("x"))} END AS description,
  CASE WHEN kind = 'nav' THEN {_unesc(_HREF)} END AS url, CAST(NULL AS VARCHAR) AS salary, CAST(NULL AS VARCHAR) AS posted_date FROM r""")(_listing_items)


def _no_new_stream(s, d):
    src = work_path(s, "landing", "signups")
    T.as_event_time(B.view(s, d, "signups"), "ts").repartition(6).write.parquet(src)
    stream = s.readStream.schema(s.read.parquet(src).schema).option("maxFilesPerTrigger", 2).parquet(src)
    counts = work_path(s, "state", "hourly")
    T.stream_no_new(stream, counts, work_path(s, "ckpt", "no_new"))
    return T.no_new_from_counts(s.read.parquet(counts).select("hour", "n"))


register("no_new_24h_stream", with_views("signups") + _NO_NEW)(_no_new_stream)


def _errors_1h_stream(s, d):
    src = work_path(s, "landing", "errors")
    T.as_event_time(B.view(s, d, "errors"), "ts").repartition(6).write.parquet(src)
    stream = s.readStream.schema(s.read.parquet(src).schema).option("maxFilesPerTrigger", 2).parquet(src)
    counts = work_path(s, "state", "slots")
    T.stream_slot_counts(stream, counts, work_path(s, "ckpt", "errors_1h"))
    return T.errors_1h_from_counts(s.read.parquet(counts).select("slot", "n"))


register("errors_1h_stream", _WE + f""", w AS ({_win_sql(60, 10)})
SELECT c.window_start, c.window_end, c.errors, c.errors > 10 AND coalesce(p.errors, 0) > 10 AS alert
FROM w c LEFT JOIN w p ON p.window_start + INTERVAL 10 MINUTE = c.window_start""")(_errors_1h_stream)

# ---------------------------------------------------------------- rules with state


def _in_three_runs(s, rows, order, name, transform):
    """Rows landed in three parts by ``order``, the stream restarted for each from one checkpoint."""
    cuts = rows.select(F.percentile(order, [1 / 3, 2 / 3])).first()[0]
    src, out, ckpt = work_path(s, "landing", name), work_path(s, "sink", name), work_path(s, "ckpt", name)
    part = F.when(F.col(order) <= cuts[0], 0).when(F.col(order) <= cuts[1], 1).otherwise(2)
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(src)
        stream = s.readStream.schema(rows.schema).parquet(src)
        I.run_to_parquet(transform(stream), out, ckpt)
    return s.read.parquet(out)


def _stop_sql(ends: str) -> str:
    """A source's pages up to its first end are kept; streaks by gaps and islands over all its pages."""
    return with_views("source_pages") + f""", e AS (SELECT *, rank - max(CASE WHEN n_postings > 0 THEN rank ELSE 0 END) OVER w AS empties, rank - max(CASE WHEN NOT failed THEN rank ELSE 0 END) OVER w AS fails
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page) AS rank FROM source_pages) WINDOW w AS (PARTITION BY source ORDER BY page)),
k AS (SELECT *, page <= coalesce(min(CASE WHEN {ends} THEN page END) OVER (PARTITION BY source), page) AS kept FROM e)
SELECT source, page, n_postings, CASE WHEN kept THEN 'kept' ELSE 'after_stop' END AS status, CASE WHEN kept THEN empties ELSE 0 END AS empty_streak,
  CASE WHEN kept THEN fails ELSE 0 END AS failure_streak, kept AND fails >= 5 AS alert FROM k"""


for _name, _max, _ends in (("stream_stop", None, "n_postings = 0 OR NOT has_next"), ("stream_stop_streak", 3, "empties >= 3")):
    register(_name, _stop_sql(_ends))(
        lambda s, d, name=_name, most=_max: _in_three_runs(s, B.view(s, d, "source_pages").drop("ts"), "page", name, lambda x: ST.stop_pages(x, most)))

register("no_new_timer", with_views("source_new") + """, n AS (SELECT source, ts, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS following,
  max(ts) OVER () - INTERVAL 1 HOUR AS watermark FROM (SELECT DISTINCT source, ts FROM source_new)),
g AS (SELECT * FROM n WHERE coalesce(following > ts + INTERVAL 25 HOUR, ts + INTERVAL 25 HOUR < watermark))
SELECT source, 'fired' AS event, ts + INTERVAL 25 HOUR AS at, ts AS last_seen FROM g
UNION ALL SELECT source, 'cleared', following, ts FROM g WHERE following IS NOT NULL""")(
    lambda s, d: _in_three_runs(s, B.view(s, d, "source_new").select("source", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("timestamp").cast("double").alias("t")),
                                "t", "no_new_timer", ST.no_new_alerts)
    .select("source", "event", F.col("at").cast("timestamp_ntz").alias("at"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen")))
