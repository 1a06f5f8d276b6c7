"""Catalog: projections, cleaning rules and formatters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as CL
from ..functions import derived as D
from ..functions import formatting as N
from ..operators import aggregates as A
from ..operators import cleaning as CO
from ..operators import rows as RW
from . import binding as B
from .oracle import AS_OF, salary_bounds, with_views
from .registry import register

W = with_views("postings")
WD = with_views("postings", derived=True)


def P(s, d):
    return B.postings(s, d)


# ---------------------------------------------------------------- C03-C10
register("location_ids", W + """SELECT id,
  CASE WHEN json_type(locations) = 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(flatten(
      list_transform(from_json(locations, '[{"province":{"id":"BIGINT"},"city":{"id":"BIGINT"}}]'),
                     lambda x: [x.province.id, x.city.id])), lambda y: y IS NOT NULL), lambda z: printf('%03d', z)), ','), '')
       ELSE '' END AS location_ids
FROM postings""")(lambda s, d: P(s, d).select("id", D.location_ids().alias("location_ids")))

_codes = " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.TAG_CODES.items())
register("tag_number", W + f"""SELECT id,
  CASE WHEN json_type(tags) = 'ARRAY' THEN coalesce(nullif(array_to_string(list_sort(list_distinct(
      list_transform(from_json(tags, '["VARCHAR"]'), lambda t: CASE t {_codes} ELSE 0 END))), ','), ''), '0')
       ELSE '0' END AS tag_number
FROM postings""")(lambda s, d: P(s, d).select("id", D.tag_number().alias("tag_number")))

_FLAGS = ", ".join(D.TAG_FLAGS)
register("tag_flags", WD + f"SELECT id, {_FLAGS} FROM postings_d")(
    lambda s, d: P(s, d).select("id", *[c.alias(n) for n, c in D.tag_flags().items()]))
register("job_board_titles", WD + "SELECT id, jobBoard_titleEn, jobBoard_titleFa FROM postings_d")(
    lambda s, d: P(s, d).select("id", D.job_board_title_en().alias("jobBoard_titleEn"),
                                D.job_board_title_fa().alias("jobBoard_titleFa")))
register("primary_city", WD + "SELECT id, primary_city FROM postings_d")(
    lambda s, d: P(s, d).select("id", D.primary_city().alias("primary_city")))
register("work_type", WD + "SELECT id, work_type FROM postings_d")(
    lambda s, d: P(s, d).select("id", D.work_type().alias("work_type")))
register("category_hierarchy", WD + "SELECT id, category, parent_cat, sub_cat FROM postings_d")(
    lambda s, d: P(s, d).select("id", *[c.alias(n) for n, c in D.category_hierarchy().items()]))
register("derive_all", WD + f"""SELECT id, title, {_FLAGS}, jobBoard_titleEn, jobBoard_titleFa, primary_city,
  work_type, category, parent_cat, sub_cat FROM postings_d""")(
    lambda s, d: D.derive_all(P(s, d)).select("id", "title", *D.derived_columns().keys()))

# ---------------------------------------------------------------- C11 / C12
register("serialize_posting", WD + """SELECT id, title, coalesce(company_name_en, company_name_fa) AS company,
  CASE WHEN activation_time IS NULL THEN NULL ELSE strftime(activation_time, '%Y-%m-%dT%H:%M:%S') END AS activation_time,
  url, primary_city AS location, work_type AS job_type, category,
  tag_remote = 1 AS is_remote, tag_part_time = 1 AS is_part_time, tag_internship = 1 AS is_internship,
  NOT (tag_no_experience = 1) AS requires_experience, tag_military_exemption = 1 AS military_exemption
FROM postings_d""")(lambda s, d: RW.serialize_posting(P(s, d)))

register("display_fields", with_views("postings_text") + """SELECT id,
  coalesce(nullif(trim(company_name_en), ''), nullif(trim(company_name_fa), ''), 'Not specified') AS company_display,
  coalesce(CASE WHEN json_type(locations) = 'ARRAY' THEN json_extract_string(locations, '$[0].city.titleEn') END, 'Not specified') AS location_display,
  coalesce(CASE WHEN json_type(work_types) = 'ARRAY' THEN json_extract_string(work_types, '$[0].titleEn') END, 'Not specified') AS work_type_display,
  CASE WHEN json_valid(salary) AND json_extract(salary, '$.min') IS NOT NULL AND json_extract(salary, '$.max') IS NOT NULL
       THEN concat(CAST(json_extract(salary, '$.min') AS VARCHAR), ' - ', CAST(json_extract(salary, '$.max') AS VARCHAR))
       ELSE salary END AS salary_display,
  CASE WHEN description IS NULL THEN NULL WHEN length(description) <= 155 THEN description
       ELSE concat(regexp_replace(substr(description, 1, 147), ' [^ ]*$', ''), '...') END AS description_short
FROM postings_text""")(
    lambda s, d: D.display_fields(B.view(s, d, "postings_text")).select(
        "id", "company_display", "location_display", "work_type_display", "salary_display", "description_short"))

# ---------------------------------------------------------------- C13-C16
register("validate_required", W + """SELECT id FROM postings
WHERE id IS NOT NULL AND title IS NOT NULL AND company_name_en IS NOT NULL
  AND trim(id) <> '' AND trim(title) <> '' AND trim(company_name_en) <> ''""")(
    lambda s, d: CO.validate_required(P(s, d), CO.RULES["collect_v2"], nonblank=True).select("id"))

_REASON = """CASE WHEN title IS NULL THEN 'missing_title' WHEN url IS NULL THEN 'missing_url'
       WHEN locations IS NULL THEN 'missing_locations' WHEN trim(title) = '' THEN 'empty_title'
       WHEN trim(url) = '' THEN 'empty_url'
       WHEN json_valid(locations) AND json_type(locations) = 'ARRAY' AND json_array_length(locations) = 0 THEN 'empty_locations'
       WHEN json_valid(locations) AND json_type(locations) <> 'ARRAY' THEN 'locations_not_list' END"""
register("validate_posting", W + f"""SELECT id, {_REASON} AS reject_reason, ({_REASON}) IS NULL AS is_valid
FROM postings""")(lambda s, d: CO.validate_posting(P(s, d)).select("id", "reject_reason", "is_valid"))


def _json_or(c, default):
    return f"CASE WHEN {c} IS NULL OR NOT json_valid({c}) THEN '{default}' ELSE {c} END AS {c}"


register("validate_import", W + f"""SELECT id, coalesce(nullif(title, ''), 'Untitled Job') AS title,
  {_json_or('locations', '[]')}, {_json_or('tags', '[]')}, {_json_or('salary', '{}')},
  {_json_or('raw_data', CO.DEFAULT_RAW)}
FROM postings WHERE id IS NOT NULL AND id <> ''""")(
    lambda s, d: CO.validate_import(P(s, d)).select("id", "title", "locations", "tags", "salary", "raw_data"))

register("flatten_nested", W + """SELECT id,
  CAST(json_object('en', company_name_en, 'fa', company_name_fa, 'id', company_id) AS VARCHAR) AS company,
  CAST(to_json([title, url]) AS VARCHAR) AS pair
FROM postings""")(
    lambda s, d: CO.flatten_nested(P(s, d).select(
        "id", F.struct(F.col("company_name_en").alias("en"), F.col("company_name_fa").alias("fa"),
                       F.col("company_id").alias("id")).alias("company"),
        F.array("title", "url").alias("pair"))))

# ---------------------------------------------------------------- C17-C28
register("trim_text", W + "SELECT id, trim(concat('  ', title, ' ')) AS title, trim(company_name_fa) AS company_name_fa FROM postings")(
    lambda s, d: P(s, d).select("id", CL.trim_text(F.concat(F.lit("  "), "title", F.lit(" "))).alias("title"),
                                CL.trim_text("company_name_fa").alias("company_name_fa")))

_SHAPE_A = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z| \d{2}:\d{2}:\d{2})?$"
_SHAPE_DB = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
_TS = with_views("ts_texts")
register("parse_timestamp", _TS + f"""SELECT event_id,
  CASE WHEN regexp_matches(ts_text, '{_SHAPE_A}') THEN CAST(replace(replace(ts_text, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS parsed,
  CASE WHEN regexp_matches(ts_text, '{_SHAPE_DB}') THEN CAST(replace(ts_text, 'T', ' ') AS TIMESTAMP) END AS parsed_db
FROM ts_texts""")(
    lambda s, d: B.view(s, d, "ts_texts").select(
        "event_id", CL.parse_timestamp("ts_text").alias("parsed"),
        CL.parse_timestamp("ts_text", CL.DB_TS_SHAPE).alias("parsed_db")))
register("normalize_timestamp_text", _TS + f"""SELECT event_id,
  CASE WHEN regexp_matches(ts_text, '{_SHAPE_A}')
       THEN CASE WHEN microsecond(CAST(replace(replace(ts_text, 'T', ' '), 'Z', '') AS TIMESTAMP)) % 1000000 = 0
                 THEN strftime(CAST(replace(replace(ts_text, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')
                 ELSE strftime(CAST(replace(replace(ts_text, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') END
       ELSE ts_text END AS ts_iso
FROM ts_texts""")(
    lambda s, d: B.view(s, d, "ts_texts").select("event_id", CL.normalize_timestamp_text("ts_text").alias("ts_iso")))

register("normalize_locations", W + """SELECT id,
  CASE WHEN locations IS NULL THEN '[]' WHEN NOT json_valid(locations) THEN CAST(to_json([locations]) AS VARCHAR)
       ELSE locations END AS locations
FROM postings""")(lambda s, d: P(s, d).select("id", CL.normalize_locations("locations").alias("locations")))

_lo, _hi = salary_bounds("salary")
register("normalize_salary", W + f"""SELECT id,
  CASE WHEN salary IS NULL OR salary = '' THEN salary WHEN NOT json_valid(salary) THEN CAST(json_object('raw', salary) AS VARCHAR)
       ELSE salary END AS salary,
  {_lo} AS normalize_salary_min, {_hi} AS normalize_salary_max
FROM postings""")(lambda s, d: P(s, d).select("id", *[c.alias(n) for n, c in CL.normalize_salary("salary").items()]))
register("canonical_salary", W + """SELECT id, CASE WHEN salary IS NULL OR trim(salary) = '' THEN '' ELSE salary END AS salary
FROM postings""")(lambda s, d: P(s, d).select("id", CL.canonical_salary("salary").alias("salary")))
register("fix_url", W + """SELECT id,
  CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url WHEN url LIKE '//%' THEN concat('https:', url)
       ELSE concat('https://', url) END AS url,
  concat('https://', concat('//', url)) AS url_orm,
  CASE WHEN concat('//', url) LIKE '//%' THEN concat('https:', concat('//', url)) END AS url_slashes
FROM postings""")(
    lambda s, d: P(s, d).select("id", CL.fix_url("url").alias("url"),
                                CL.fix_url(F.concat(F.lit("//"), "url"), always_prefix=True).alias("url_orm"),
                                CL.fix_url(F.concat(F.lit("//"), "url")).alias("url_slashes")))
register("truncate_description", with_views("postings_text") + """SELECT id, left(description, 65535) AS description
FROM postings_text""")(lambda s, d: B.view(s, d, "postings_text").select(
    "id", CL.truncate_description("description").alias("description")))
register("default_source", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, ''), 'api_scraper') AS source FROM documents")(
    lambda s, d: B.table(s, d, "documents").select(
        "doc_id", CL.default_source(F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("source"))).alias("source")))
register("surrogate_id", W + """SELECT coalesce(nullif(company_name_en, ''), md5(concat_ws('-', coalesce(title, ''), coalesce(url, '')))) AS id,
  title FROM postings""")(
    lambda s, d: P(s, d).select(CL.surrogate_id("company_name_en").alias("id"), "title"))
register("clean_report", with_views("arrivals") + f"""
, per_id AS (
  SELECT id, count(*) AS n, arg_min(({_REASON}) IS NULL, (page, position)) AS ok FROM arrivals GROUP BY id)
SELECT CAST(sum(n) AS BIGINT) AS input, count(*) FILTER (WHERE ok) AS valid, CAST(sum(n - 1) AS BIGINT) AS duplicates,
       count(*) FILTER (WHERE NOT ok) AS invalid FROM per_id""")(
    lambda s, d: CO.clean_report(B.view(s, d, "arrivals")))
register("cast_id", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey FROM orders")(
    lambda s, d: B.table(s, d, "orders").select(CL.cast_id("o_orderkey").alias("id"), "o_custkey"))
register("flatten_dotted", W + """SELECT id, company_name_en AS "company.name.en", company_name_fa AS "company.name.fa",
  company_id AS "company.id", url AS "link.url" FROM postings""")(
    lambda s, d: CO.flatten_dotted(P(s, d).select(
        "id", F.struct(F.struct(F.col("company_name_en").alias("en"), F.col("company_name_fa").alias("fa")).alias("name"),
                       F.col("company_id").alias("id")).alias("company"),
        F.struct(F.col("url").alias("url")).alias("link"))))

# ---------------------------------------------------------------- N01-N05
register("format_datetime", W + """SELECT id, CASE WHEN activation_time IS NULL THEN '' ELSE strftime(activation_time, '%B %d, %Y') END AS posted
FROM postings""")(lambda s, d: P(s, d).select("id", N.format_datetime("activation_time").alias("posted")))
register("format_relative_time", W + f"""SELECT id,
  CASE WHEN activation_time IS NULL THEN ''
       WHEN sec < 0 THEN 'in the future' WHEN sec < 60 THEN 'just now'
       WHEN sec < 3600 THEN concat(CAST(sec // 60 AS VARCHAR), ' minute', CASE WHEN sec // 60 = 1 THEN '' ELSE 's' END, ' ago')
       WHEN sec < 86400 THEN concat(CAST(sec // 3600 AS VARCHAR), ' hour', CASE WHEN sec // 3600 = 1 THEN '' ELSE 's' END, ' ago')
       WHEN sec // 86400 = 1 THEN 'yesterday'
       WHEN sec // 86400 < 7 THEN concat(CAST(sec // 86400 AS VARCHAR), ' days ago')
       WHEN sec // 86400 < 30 THEN concat(CAST(sec // 86400 // 7 AS VARCHAR), ' week', CASE WHEN sec // 86400 // 7 = 1 THEN '' ELSE 's' END, ' ago')
       WHEN sec // 86400 < 365 THEN concat(CAST(sec // 86400 // 30 AS VARCHAR), ' month', CASE WHEN sec // 86400 // 30 = 1 THEN '' ELSE 's' END, ' ago')
       ELSE concat(CAST(sec // 86400 // 365 AS VARCHAR), ' year', CASE WHEN sec // 86400 // 365 = 1 THEN '' ELSE 's' END, ' ago') END AS ago
FROM (SELECT id, activation_time, CAST(epoch({AS_OF}) - epoch(activation_time) AS BIGINT) AS sec FROM postings) t""")(
    lambda s, d: P(s, d).select("id", N.format_relative_time("activation_time", A.as_of_max(P(s, d))).alias("ago")))
register("format_currency", "SELECT o_orderkey, concat('$', format('{:,.2f}', o_totalprice)) AS price FROM orders")(
    lambda s, d: B.table(s, d, "orders").select("o_orderkey", N.format_currency("o_totalprice").alias("price")))
register("pluralize", WD + """SELECT company, n, concat(CAST(n AS VARCHAR), ' ', CASE WHEN n = 1 THEN 'job' ELSE 'jobs' END) AS label
FROM (SELECT company_id AS company, count(*) AS n FROM postings GROUP BY company_id) t""")(
    lambda s, d: P(s, d).groupBy(F.col("company_id").alias("company")).agg(F.count(F.lit(1)).alias("n")).select(
        "company", "n", F.concat(F.col("n").cast("string"), F.lit(" "), N.pluralize("n", "job")).alias("label")))
register("format_filesize", """SELECT doc_id, CASE
  WHEN n_chars * 37 < 1024 THEN concat(printf('%.1f', round(CAST(n_chars * 37 AS DOUBLE), 1)), ' B')
  WHEN n_chars * 37 < 1048576 THEN concat(printf('%.1f', round(CAST(n_chars * 37 AS DOUBLE) / 1024, 1)), ' KB')
  WHEN n_chars * 37 < 1073741824 THEN concat(printf('%.1f', round(CAST(n_chars * 37 AS DOUBLE) / 1048576, 1)), ' MB')
  WHEN n_chars * 37 < 1099511627776 THEN concat(printf('%.1f', round(CAST(n_chars * 37 AS DOUBLE) / 1073741824, 1)), ' GB')
  ELSE concat(printf('%.1f', round(CAST(n_chars * 37 AS DOUBLE) / 1099511627776, 1)), ' TB') END AS size
FROM documents""")(lambda s, d: B.table(s, d, "documents").select(
    "doc_id", N.format_filesize(F.col("n_chars") * 37).alias("size")))

# ---------------------------------------------------------------- the collector's cleaning chain
_CLEAN_REASON = _REASON
register("clean_postings", with_views("postings_text") + f""", c AS (
  SELECT CASE WHEN id IS NULL OR id = '' THEN md5(concat_ws('-', coalesce(trim(title), ''), coalesce(url, ''))) ELSE id END AS id,
         trim(title) AS title, trim(company_name_en) AS company_name_en, trim(company_name_fa) AS company_name_fa,
         CASE WHEN locations IS NULL THEN '[]' WHEN NOT json_valid(locations) THEN CAST(to_json([locations]) AS VARCHAR)
              ELSE locations END AS locations,
         CASE WHEN salary IS NULL OR trim(salary) = '' THEN '' WHEN NOT json_valid(salary)
              THEN CAST(json_object('raw', salary) AS VARCHAR) ELSE salary END AS salary,
         {_lo} AS normalize_salary_min, {_hi} AS normalize_salary_max,
         CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url WHEN url LIKE '//%' THEN concat('https:', url)
              ELSE concat('https://', url) END AS url,
         left(description, 65535) AS description, 'api_scraper' AS source
  FROM postings_text)
SELECT id, title, company_name_en, company_name_fa, locations, salary, normalize_salary_min, normalize_salary_max,
       url, description, source, {_CLEAN_REASON} AS reject_reason, ({_CLEAN_REASON}) IS NULL AS is_valid
FROM c""")(
    lambda s, d: CO.clean_postings(B.view(s, d, "postings_text")).select(
        "id", "title", "company_name_en", "company_name_fa", "locations", "salary", "normalize_salary_min",
        "normalize_salary_max", "url", "description", "source", "reject_reason", "is_valid"))

register("serialize_posting_tags", with_views("posting_tags", "tags", derived=True) + """, per AS (
  SELECT b.posting_id, string_agg(DISTINCT b.tag_name, ',' ORDER BY b.tag_name) AS tag_names
  FROM posting_tags b JOIN tags t ON t.name = b.tag_name GROUP BY b.posting_id)
SELECT coalesce(per.tag_names, '') AS tag_names, id, title, coalesce(company_name_en, company_name_fa) AS company,
  CASE WHEN activation_time IS NULL THEN NULL ELSE strftime(activation_time, '%Y-%m-%dT%H:%M:%S') END AS activation_time,
  url, primary_city AS location, work_type AS job_type, category,
  tag_remote = 1 AS is_remote, tag_part_time = 1 AS is_part_time, tag_internship = 1 AS is_internship,
  NOT (tag_no_experience = 1) AS requires_experience, tag_military_exemption = 1 AS military_exemption
FROM postings_d p LEFT JOIN per ON per.posting_id = p.id""")(
    lambda s, d: RW.serialize_posting(
        P(s, d), B.view(s, d, "posting_tags"), B.view(s, d, "tags")))
