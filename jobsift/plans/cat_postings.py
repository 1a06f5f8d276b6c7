"""Catalog: statistics, filters and search over the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derived as D
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import search as R
from ..operators import textindex as X
from ..session import shuffles_removed, work_path
from . import binding as B
from .oracle import AS_OF, salary_value, with_views
from .registry import register

W = with_views("postings")
WD = with_views("postings", derived=True)


def P(spark, sf):
    return B.postings(spark, sf)


def PD(spark, sf):
    return D.derive_all(B.postings(spark, sf))


def _top(key_sql: str, name: str, where: str = "", n: str = "n", src: str = "postings_d", k: int = 10) -> str:
    w = f"WHERE {where}" if where else ""
    return (f"SELECT {key_sql} AS {name}, count(*) AS {n} FROM {src} p {w} GROUP BY 1 "
            f"ORDER BY {n} DESC, {name} ASC NULLS FIRST LIMIT {k}")


# ---------------------------------------------------------------- A01-A13
register("count_postings", W + "SELECT count(*) AS total FROM postings")(
    lambda s, d: A.count_postings(P(s, d)))

_SPEC = {"keywords": "high", "date_from": "1996-01-01", "date_to": "1998-12-31 23:59:59"}
register("count_filtered", W + """SELECT count(*) AS total FROM postings
WHERE title ILIKE '%high%' AND activation_time >= TIMESTAMP '1996-01-01'
  AND activation_time <= TIMESTAMP '1998-12-31 23:59:59'""")(
    lambda s, d: A.count_filtered(P(s, d), _SPEC))


def _by_day(bound_sql: str, strict: bool = False, name="day", n="n") -> str:
    op = ">" if strict else ">="
    return W + (f"SELECT CAST(date_trunc('day', activation_time) AS TIMESTAMP) AS {name}, count(*) AS {n} "
                f"FROM postings WHERE activation_time {op} {bound_sql} GROUP BY 1")


register("by_day_30d", _by_day(f"date_trunc('day', {AS_OF}) - INTERVAL 30 DAY"))(
    lambda s, d: A.by_day_30d(P(s, d), A.as_of_max(P(s, d))))
register("by_day_30d_rolling", _by_day(f"{AS_OF} - INTERVAL 30 DAY"))(
    lambda s, d: A.by_day_30d_rolling(P(s, d), A.as_of_max(P(s, d))))
register("trend_90d", _by_day(f"date_trunc('day', {AS_OF}) - INTERVAL 90 DAY", strict=True,
                              name="post_date", n="job_count"))(
    lambda s, d: A.trend_90d(P(s, d), A.as_of_max(P(s, d))))

register("top_companies", WD + _top("company_name_en", "company", "company_name_en IS NOT NULL AND company_name_en <> ''"))(
    lambda s, d: A.top_companies(P(s, d)))
register("top_companies_named", WD + _top("coalesce(company_name_en, company_name_fa, 'Unknown')", "company"))(
    lambda s, d: A.top_companies_named(P(s, d)))
register("top_job_boards", WD + _top("jobBoard_titleEn", "job_board", "jobBoard_titleEn IS NOT NULL AND jobBoard_titleEn <> ''"))(
    lambda s, d: A.top_job_boards(P(s, d)))
register("top_cities", WD + _top("primary_city", "location", "primary_city IS NOT NULL AND primary_city <> ''"),
         headline=True)(lambda s, d: A.top_cities(P(s, d)))
register("top_categories", WD + _top("category", "category", "category IS NOT NULL AND category <> ''"))(
    lambda s, d: A.top_categories(P(s, d)))
register("top_provinces", WD + "SELECT * FROM (" + _top(
    "CASE WHEN json_type(locations) = 'ARRAY' THEN json_extract_string(locations, '$[0].province.name') END",
    "location", "locations LIKE '%province%'") + ") t WHERE location IS NOT NULL")(
    lambda s, d: A.top_provinces(P(s, d)))
register("location_distribution", WD + _top(
    "CASE WHEN locations IS NULL OR locations = '[]' THEN 'Unknown' "
    "WHEN json_type(locations) = 'ARRAY' THEN CAST(json_extract(locations, '$[0].city') AS VARCHAR) END",
    "location", n="job_count"))(lambda s, d: A.location_distribution(P(s, d)))
register("category_distribution", WD + _top(
    "coalesce(CASE WHEN json_type(job_post_categories) = 'ARRAY' THEN json_extract_string(job_post_categories, '$[0].titleEn') END, 'Uncategorized')",
    "category_name", n="job_count"))(lambda s, d: A.category_distribution(P(s, d)))

# ---------------------------------------------------------------- A14 / A15
_STATS_SQL = WD + f""", keyed AS (
  SELECT CASE WHEN activation_time >= date_trunc('day', {AS_OF}) - INTERVAL 30 DAY
              THEN strftime(activation_time, '%Y-%m-%d') END AS k_day,
         company_name_en AS k_company, jobBoard_titleEn AS k_board, primary_city AS k_city, category AS k_category
  FROM postings_d),
sets AS (
  SELECT 'by_date' AS stat, k_day AS key, count(*) AS n FROM keyed WHERE k_day IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'by_company', k_company, count(*) FROM keyed WHERE k_company <> '' GROUP BY 2
  UNION ALL SELECT 'by_job_board', k_board, count(*) FROM keyed WHERE k_board <> '' GROUP BY 2
  UNION ALL SELECT 'by_location', k_city, count(*) FROM keyed WHERE k_city <> '' GROUP BY 2
  UNION ALL SELECT 'by_category', k_category, count(*) FROM keyed WHERE k_category <> '' GROUP BY 2),
ranked AS (
  SELECT stat, key, n,
         CAST(CASE WHEN stat = 'by_date' THEN row_number() OVER (PARTITION BY stat ORDER BY key DESC)
              ELSE row_number() OVER (PARTITION BY stat ORDER BY n DESC, key ASC NULLS FIRST) END AS INTEGER) AS rank
  FROM sets)
SELECT stat, key, n, rank FROM ranked WHERE stat = 'by_date' OR rank <= 10
UNION ALL SELECT 'total', NULL, count(*), 1 FROM postings_d
"""
register("job_statistics", _STATS_SQL, headline=True)(
    lambda s, d: A.job_statistics(P(s, d), A.as_of_max(P(s, d))))

# the clock 200 days before the newest posting: more days than any fixed number of rows
register("job_statistics_past", _STATS_SQL.replace(AS_OF, f"({AS_OF} - INTERVAL 200 DAY)"))(
    lambda s, d: A.job_statistics(P(s, d), A.as_of_max(P(s, d)) - F.expr("INTERVAL 200 DAYS")))

_WEB_SQL = WD + f""", keyed AS (
  SELECT CASE WHEN activation_time >= {AS_OF} - INTERVAL 30 DAY THEN strftime(activation_time, '%Y-%m-%d') END AS k_day,
         coalesce(company_name_en, company_name_fa, 'Unknown') AS k_company,
         locations LIKE '%province%' AS k_guard,
         CASE WHEN json_type(locations) = 'ARRAY' THEN json_extract_string(locations, '$[0].province.name') END AS k_prov
  FROM postings_d),
sets AS (
  SELECT 'by_date' AS stat, k_day AS key, count(*) AS n FROM keyed WHERE k_day IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'by_company', k_company, count(*) FROM keyed GROUP BY 2
  UNION ALL SELECT 'by_location', k_prov, count(*) FROM keyed WHERE k_guard GROUP BY 2),
ranked AS (
  SELECT stat, key, n,
         CAST(CASE WHEN stat = 'by_date' THEN row_number() OVER (PARTITION BY stat ORDER BY key DESC)
              ELSE row_number() OVER (PARTITION BY stat ORDER BY n DESC, key ASC NULLS FIRST) END AS INTEGER) AS rank
  FROM sets)
SELECT stat, key, n, rank FROM ranked
WHERE (stat = 'by_date' OR rank <= 10) AND NOT (stat = 'by_location' AND key IS NULL)
UNION ALL SELECT 'total', NULL, count(*), 1 FROM postings_d
"""
register("web_statistics", _WEB_SQL)(lambda s, d: A.web_statistics(P(s, d), A.as_of_max(P(s, d))))

# ---------------------------------------------------------------- A21 / A25 / A26 / A27


def _salary_sql(key_sql: str, name: str) -> str:
    return WD + f""", base AS (
  SELECT {key_sql} AS {name}, {salary_value('p.salary')} AS salary_value FROM postings_d p)
SELECT {name}, count(*) AS n, min(salary_value) AS min_salary, round(avg(salary_value), 2) AS mean_salary,
       max(salary_value) AS max_salary,
       round(quantile_cont(salary_value, 0.25), 2) AS p25_salary,
       round(quantile_cont(salary_value, 0.5), 2) AS p50_salary,
       round(quantile_cont(salary_value, 0.75), 2) AS p75_salary
FROM base WHERE salary_value IS NOT NULL AND {name} IS NOT NULL GROUP BY {name}
"""


register("salary_by_category", _salary_sql("category", "category"))(lambda s, d: A.salary_by_category(P(s, d)))
register("salary_by_city", _salary_sql("primary_city", "city"))(lambda s, d: A.salary_by_city(P(s, d)))
register("salary_trend", WD + f""", base AS (
  SELECT CAST(date_trunc('month', activation_time) AS TIMESTAMP) AS month, {salary_value('p.salary')} AS salary_value
  FROM postings_d p WHERE activation_time IS NOT NULL)
SELECT month, count(*) AS n, round(avg(salary_value), 2) AS mean_salary,
       round(quantile_cont(salary_value, 0.5), 2) AS median_salary
FROM base WHERE salary_value IS NOT NULL GROUP BY month
""")(lambda s, d: A.salary_trend(P(s, d)))

register("activity_7d", W + f""", cal AS (
  SELECT CAST(d AS TIMESTAMP) AS day FROM range(CAST(CAST({AS_OF} AS DATE) - INTERVAL 7 DAY AS TIMESTAMP),
                                           CAST(CAST({AS_OF} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY) t(d))
SELECT cal.day, CAST(count(p.id) AS BIGINT) AS n
FROM cal LEFT JOIN postings p ON CAST(date_trunc('day', p.activation_time) AS TIMESTAMP) = cal.day
GROUP BY cal.day
""")(lambda s, d: A.activity_7d(P(s, d), A.as_of_max(P(s, d))))

# ---------------------------------------------------------------- F01-F14
_ID_COLS = "id, title, activation_time"


def _filtered(where: str, src: str = "postings_d", cols: str = _ID_COLS, views=WD) -> str:
    return views + f"SELECT {cols} FROM {src} WHERE {where}"


def _sel(df):
    return df.select("id", "title", "activation_time")


register("between_dates", _filtered("activation_time >= TIMESTAMP '1997-01-01' AND activation_time <= TIMESTAMP '1997-06-30'"))(
    lambda s, d: _sel(P(s, d).where(FL.between_dates("1997-01-01", "1997-06-30"))))
register("title_keyword", _filtered("title ILIKE '%urgent%'"))(
    lambda s, d: _sel(P(s, d).where(FL.title_keyword("urgent"))))
register("keyword_any", _filtered("title ILIKE '%mach%' OR description ILIKE '%mach%'", src="postings_text",
                                  views=with_views("postings_text")))(
    lambda s, d: _sel(B.view(s, d, "postings_text").where(FL.keyword_any("mach"))))
register("company_like", _filtered("company_name_en ILIKE '%r#00000012%'"))(
    lambda s, d: _sel(P(s, d).where(FL.company_like("r#00000012"))))
register("company_like_any", _filtered("company_name_en ILIKE '%fa customer#0000001%' OR company_name_fa ILIKE '%fa customer#0000001%'"))(
    lambda s, d: _sel(P(s, d).where(FL.company_like("fa customer#0000001", both=True))))
register("location_text", _filtered("locations ILIKE '%algeria%'"))(
    lambda s, d: _sel(P(s, d).where(FL.location_text("algeria"))))
register("location_text_found", _filtered("locations ILIKE '%asia%'"))(
    lambda s, d: _sel(P(s, d).where(FL.location_text("asia"))))
register("category_like", _filtered("category ILIKE '%build%'"))(
    lambda s, d: _sel(PD(s, d).where(FL.category_like("build"))))
register("flag_filters", _filtered("tag_remote = 1"))(
    lambda s, d: _sel(PD(s, d).where(FL.flag_filters(remote=True, no_experience=None))))
register("posted_within_days", _filtered(f"activation_time >= {AS_OF} - INTERVAL 90 DAY", src="postings", views=W))(
    lambda s, d: _sel(P(s, d).where(FL.posted_within_days("90", A.as_of_max(P(s, d))))))
register("equals_key", _filtered("batch_id = 'b7'"))(
    lambda s, d: _sel(P(s, d).where(FL.equals_key("batch_id", "b7"))))
register("by_id", _filtered("id = '42'"))(lambda s, d: _sel(FL.by_id(P(s, d), 42)))

_SPEC2 = {"date_from": "1996-01-01", "keywords": "a", "category": "e", "no_experience": True, "remote": "yes",
          "company": ""}
register("filter_spec", _filtered("activation_time >= TIMESTAMP '1996-01-01' AND title ILIKE '%a%' "
                                  "AND category ILIKE '%e%' AND tag_no_experience = 1"))(
    lambda s, d: _sel(PD(s, d).where(FL.filter_spec(_SPEC2))))
register("facet_filters", _filtered(
    "json_type(tags) = 'ARRAY' AND len(list_intersect(from_json(tags, '[\"VARCHAR\"]'), ['دورکاری', 'کارآموزی'])) > 0 "
    "AND work_type IN ('Full time', 'Contract')"))(
    lambda s, d: _sel(P(s, d).where(FL.facet_filters(tags=["دورکاری", "کارآموزی"], job_types=["Full time", "Contract"]))))
register("nonempty_text", _filtered("company_name_en IS NOT NULL AND company_name_en <> ''"))(
    lambda s, d: _sel(P(s, d).where(FL.nonempty_text("company_name_en"))))
register("json_text_guard", _filtered("locations LIKE '%province%'"))(
    lambda s, d: _sel(P(s, d).where(FL.json_text_guard("province"))))

# ---------------------------------------------------------------- R01-R08
register("recent", W + """SELECT id, title, company_name_en, company_name_fa, activation_time, url FROM postings
ORDER BY activation_time DESC NULLS FIRST, id ASC LIMIT 10""")(lambda s, d: R.recent(P(s, d), 10))

register("filtered_page", WD + """SELECT id, title, company_name_en, company_name_fa, activation_time, url, salary,
       locations, primary_city, category, tag_remote, tag_no_experience, tag_part_time, tag_internship
FROM postings_d WHERE title ILIKE '%high%' AND category ILIKE '%a%'
ORDER BY activation_time DESC NULLS FIRST, id ASC LIMIT 100 OFFSET 20""")(
    lambda s, d: R.filtered_page(P(s, d), {"keywords": "high", "category": "a"}, limit=100, offset=20))

_SEARCH_WHERE = ("(title ILIKE '%high%' OR description ILIKE '%high%') AND locations ILIKE '%europe%' "
                 "AND (company_name_en ILIKE '%customer%' OR company_name_fa ILIKE '%customer%')")
_TW = with_views("postings_text")
register("search", _TW + f"""SELECT * FROM postings_text WHERE {_SEARCH_WHERE}
ORDER BY activation_time DESC NULLS LAST, id ASC LIMIT 25 OFFSET 25""")(
    lambda s, d: R.search(B.view(s, d, "postings_text"), keyword="high", location="europe", company="customer",
                          sort="date", page=2, limit=25)[0])
register("search_total", _TW + f"SELECT count(*) AS total FROM postings_text WHERE {_SEARCH_WHERE}")(
    lambda s, d: R.search(B.view(s, d, "postings_text"), keyword="high", location="europe", company="customer",
                          sort="date", page=2, limit=25)[1])
register("search_by_company", _TW + """SELECT * FROM postings_text WHERE activation_time >= (SELECT max(activation_time) FROM postings) - INTERVAL 365 DAY
ORDER BY company_name_en ASC NULLS LAST, company_name_fa ASC NULLS LAST, id ASC LIMIT 25""")(
    lambda s, d: R.search(B.view(s, d, "postings_text"), days="365", sort="company", page=1, limit=25,
                          as_of=A.as_of_max(P(s, d)))[0])
register("relevance_order", _TW + """SELECT * FROM postings_text WHERE title ILIKE '%mach%' OR description ILIKE '%mach%'
ORDER BY CASE WHEN title ILIKE '%mach%' THEN 0 ELSE 1 END, activation_time DESC NULLS LAST, id ASC LIMIT 50""")(
    lambda s, d: R.search(B.view(s, d, "postings_text"), keyword="mach", sort="relevance", page=1, limit=50)[0])
register("page_info", W + """SELECT total, 3 AS page, 25 AS per_page, CAST(ceil(total / 25) AS BIGINT) AS total_pages,
       array_to_string(range(greatest(1, 3 - 2), least(CAST(ceil(total / 25) AS BIGINT), 3 + 2) + 1), ',') AS page_window
FROM (SELECT count(*) AS total FROM postings WHERE title ILIKE '%urgent%') t""")(
    lambda s, d: R.page_info(R.search(P(s, d).withColumn("description", F.lit(None).cast("string")),
                                      keyword="urgent", page=3, limit=25)[1], 3, 25))
register("limit_rows", W + "SELECT id FROM postings")(lambda s, d: R.limit_rows(P(s, d).select("id"), 0))
register("limit_rows_some", W + "SELECT id, title FROM postings ORDER BY CAST(id AS BIGINT) LIMIT 25")(
    lambda s, d: R.limit_rows(P(s, d).select("id", "title").orderBy(F.col("id").cast("long")), 25))
register("parsed_json_columns", W + """SELECT id,
  json_valid(locations) AS locations_ok, json_valid(work_types) AS work_types_ok, json_valid(tags) AS tags_ok,
  json_valid(job_post_categories) AS job_post_categories_ok, json_valid(salary) AS salary_ok,
  CASE WHEN json_valid(salary) THEN TRY_CAST(json_extract(salary, '$.min') AS BIGINT) END AS salary_min,
  CASE WHEN json_valid(salary) THEN NULL ELSE salary END AS salary_text
FROM postings""")(
    lambda s, d: R.parsed_json_columns(P(s, d).select(
        "*", *[F.when(F.col(c).isNotNull(), F.try_parse_json(c).isNotNull()).alias(f"{c}_ok")
               for c in R.JSON_COLUMNS])).select(
        "id", *[f"{c}_ok" for c in R.JSON_COLUMNS],
        F.try_variant_get("salary", "$.min", "bigint").alias("salary_min"),
        F.when(~F.col("salary_ok"), F.try_variant_get("salary", "$", "string")).alias("salary_text")))



def _keyset_page2(s, d):
    hits = B.view(s, d, "postings_text").where(R.search_filter(keyword="high", location="europe", company="customer"))
    first = R.search(B.view(s, d, "postings_text"), keyword="high", location="europe", company="customer",
                     sort="date", page=1, limit=25)[0].select("activation_time", "id").collect()  # the shown page
    if not first:
        return hits.limit(0)  # nothing follows an empty page
    last = first[-1]
    return R.search_after(hits, (last["activation_time"], last["id"]), 25)


register("search_keyset", _TW + f"""SELECT * FROM postings_text WHERE {_SEARCH_WHERE}
ORDER BY activation_time DESC NULLS LAST, id ASC LIMIT 25 OFFSET 25""")(_keyset_page2)


def _indexed(s, d):
    """The postings stored with their texts, and the index of the table."""
    table = work_path(s, "table", "texts")
    with shuffles_removed(s):
        B.view(s, d, "postings_text").write.option("compression", "zstd").parquet(table)
        return table, X.build_index(s, table, work_path(s, "index", "texts"))


register("search_indexed", _TW + f"""SELECT * FROM postings_text WHERE {_SEARCH_WHERE}
ORDER BY activation_time DESC NULLS LAST, id ASC LIMIT 25 OFFSET 25""")(
    lambda s, d: X.search_indexed(s, *_indexed(s, d), keyword="high", location="europe", company="customer", page=2)[0])
register("search_indexed_hits", _TW + """SELECT id, title, company_name_fa FROM postings_text
WHERE (title ILIKE '%_rgent%build%' OR description ILIKE '%_rgent%build%') AND (company_name_en ILIKE '%0001%' OR company_name_fa ILIKE '%0001%')""")(
    lambda s, d: X.matching_rows(s, *_indexed(s, d), keyword="_rgent%build", company="0001").select("id", "title", "company_name_fa"))
