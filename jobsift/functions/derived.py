"""Projections from the raw posting: JSON text columns -> flat columns.

Every function returns a ``Column`` built from Spark SQL functions only, so
the whole derivation stays inside one codegen'd projection.  JSON columns
are kept as their original text (reports compare and match on the text)
and parsed on demand; repeated parses of the same column inside one
projection are shared by Catalyst's common-subexpression elimination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: tag texts and codes that must equal the reference ------
# Derived 0/1 flag column -> exact tag text it tests for.
TAG_FLAGS = {
    "tag_no_experience": "بدون نیاز به سابقه",
    "tag_remote": "دورکاری",
    "tag_part_time": "پاره وقت",
    "tag_internship": "کارآموزی",
    "tag_military_exemption": "امریه سربازی",
}
# Tag text -> numeric tag code (unknown tags map to 0).
TAG_CODES = {
    "پاره وقت": 1,
    "بدون نیاز به سابقه": 2,
    "پروژه ای": 3,
    "کارآموزی": 4,
}
# --- end of fixed values -------------------------------------------------

LOCATION_IDS_SCHEMA = "array<struct<province:struct<id:bigint>,city:struct<id:bigint>>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_json_array(c) -> Column:
    """True when the text is a JSON array (PostgreSQL ``jsonb_typeof = 'array'``)."""
    return F.json_array_length(_c(c)).isNotNull()


def json_array(c, element_schema: str) -> Column:
    """Parse a JSON array column; NULL unless the text really is an array.

    ``from_json`` with an array schema wraps a lone object into a one-element
    array, so the array test is needed to keep the reference semantics.
    """
    return F.when(is_json_array(c), F.from_json(_c(c), element_schema))


def tags_array(c="tags") -> Column:
    return json_array(c, "array<string>")


def tag_flag(tag: str, c="tags") -> Column:
    """0/1 for an exact element match; NULL tags or NULL elements give 0."""
    return F.coalesce(F.array_contains(tags_array(c), F.lit(tag)), F.lit(False)).cast("int")


def tag_flags(c="tags") -> dict[str, Column]:
    return {name: tag_flag(tag, c) for name, tag in TAG_FLAGS.items()}


def tag_number(c="tags") -> Column:
    """Distinct sorted tag codes, comma-joined; "0" when none or not a list."""
    codes = F.create_map(*[x for k, v in TAG_CODES.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.transform(tags_array(c), lambda t: F.coalesce(F.try_element_at(codes, t), F.lit(0)))
    joined = F.array_join(F.array_sort(F.array_distinct(mapped)), ",")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("0"))


def location_ids(c="locations") -> Column:
    """Province id then city id of every location, ``%03d``, comma-joined."""
    locs = json_array(c, LOCATION_IDS_SCHEMA)
    ids = F.flatten(F.transform(locs, lambda l: F.array(l["province"]["id"], l["city"]["id"])))
    ids = F.filter(ids, lambda x: x.isNotNull())
    return F.coalesce(F.array_join(F.transform(ids, lambda x: F.format_string("%03d", x)), ","), F.lit(""))


def job_board_title_en(c="raw_data") -> Column:
    """``raw_data.jobBoard.titleEn`` when the key exists."""
    return F.get_json_object(_c(c), "$.jobBoard.titleEn")


def job_board_title_fa(c="raw_data") -> Column:
    return F.get_json_object(_c(c), "$.jobBoard.titleFa")


def primary_city(c="locations") -> Column:
    """First location's ``city.titleEn`` (NULL unless a non-empty array)."""
    return F.get_json_object(_c(c), "$[0].city.titleEn")


def primary_province(c="locations") -> Column:
    """First location's ``province.name`` (JSON path, as the web statistics read it)."""
    return F.get_json_object(_c(c), "$[0].province.name")


def work_type(c="work_types") -> Column:
    """First work type's ``titleEn``."""
    return F.get_json_object(_c(c), "$[0].titleEn")


def category_hierarchy(c="job_post_categories") -> dict[str, Column]:
    """One category -> category; two or more -> parent = first, sub = category = second."""
    n = F.json_array_length(_c(c))
    first = F.get_json_object(_c(c), "$[0].titleEn")
    second = F.get_json_object(_c(c), "$[1].titleEn")
    return {
        "category": F.when(n == 1, first).when(n >= 2, second),
        "parent_cat": F.when(n >= 2, first),
        "sub_cat": F.when(n >= 2, second),
    }


def derived_columns() -> dict[str, Column]:
    """Every trigger-maintained column, as one projection."""
    cols = dict(tag_flags())
    cols["jobBoard_titleEn"] = job_board_title_en()
    cols["jobBoard_titleFa"] = job_board_title_fa()
    cols["primary_city"] = primary_city()
    cols["work_type"] = work_type()
    cols.update(category_hierarchy())
    return cols


def derive_all(df: DataFrame) -> DataFrame:
    """C10 ``derive_all``: add the derived columns in the write path."""
    return df.withColumns(derived_columns())


def company_display(en="company_name_en", fa="company_name_fa") -> Column:
    """English name, else Persian, else ``Not specified`` (blank = missing)."""
    return F.coalesce(F.nullif(F.trim(_c(en)), F.lit("")), F.nullif(F.trim(_c(fa)), F.lit("")),
                      F.lit("Not specified"))


def truncate_words(c, length: int = 150, end: str = "...", leeway: int = 5) -> Column:
    """Jinja ``truncate`` defaults: text up to ``length + leeway`` is kept;
    longer text is cut to ``length - len(end)`` characters, the part after the
    last space dropped, and ``end`` appended.
    """
    s = _c(c)
    head = F.substring(s, 1, length - len(end))
    cut = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(s) <= length + leeway, s).otherwise(F.concat(cut, F.lit(end)))


def display_fields(df: DataFrame, description: str | None = "description") -> DataFrame:
    """C12 ``display_fields``: the labels a listing page shows."""
    n_min = F.get_json_object(F.col("salary"), "$.min")
    n_max = F.get_json_object(F.col("salary"), "$.max")
    cols = {
        "company_display": company_display(),
        "location_display": F.coalesce(primary_city(), F.lit("Not specified")),
        "work_type_display": F.coalesce(work_type(), F.lit("Not specified")),
        "salary_display": F.when(n_min.isNotNull() & n_max.isNotNull(),
                                 F.concat(n_min, F.lit(" - "), n_max)).otherwise(F.col("salary")),
    }
    if description and description in df.columns:
        cols["description_short"] = truncate_words(F.col(description), 150)
    return df.withColumns(cols)
