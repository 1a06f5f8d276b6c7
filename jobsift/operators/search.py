"""Sorts, limits, top-k and paging.

Orders always spell out NULL placement (PostgreSQL's plain ``DESC`` puts NULLs
first, Spark's puts them last) and end in an ``id`` tie-break so pages are
stable.  ``orderBy().offset().limit()`` plans as ``TakeOrderedAndProject``:
each partition keeps a bounded heap of ``offset + limit`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derived as D
from . import filters as FL

RECENT_COLUMNS = ["id", "title", "company_name_en", "company_name_fa", "activation_time", "url"]
PAGE_COLUMNS = ["id", "title", "company_name_en", "company_name_fa", "activation_time", "url", "salary",
                "locations", "primary_city", "category", "tag_remote", "tag_no_experience", "tag_part_time",
                "tag_internship"]
JSON_COLUMNS = ["locations", "work_types", "tags", "job_post_categories", "salary"]


def page_size(limit: int, most: int | None = None) -> int:
    """The rows of a page.  ``most`` is the caller's bound; a size beyond it, or below 1, is an error, never cut."""
    if int(limit) < 1 or (most is not None and int(limit) > most):
        raise ValueError(f"page size {limit} is not between 1 and {'any number' if most is None else most}")
    return int(limit)


def limit_rows(df: DataFrame, n: int | None) -> DataFrame:
    """``n > 0`` -> LIMIT n; 0 or None = all rows."""
    return df.limit(int(n)) if n and int(n) > 0 else df


def recent(df: DataFrame, limit: int = 10) -> DataFrame:
    """Newest by activation time, NULLs first (plain DESC in PostgreSQL)."""
    return (df.select(*RECENT_COLUMNS)
            .orderBy(F.desc_nulls_first("activation_time"), F.asc("id")).limit(limit))


def with_derived(df: DataFrame) -> DataFrame:
    """Postings plus the trigger-maintained derived columns."""
    return D.derive_all(df)


def filtered_page(df: DataFrame, filters: dict | None, limit: int = 100, offset: int = 0, as_of=None) -> DataFrame:
    """Filter spec + R01 order + offset/limit, fixed 14-column projection."""
    d = with_derived(df)
    return (d.where(FL.filter_spec(filters, as_of)).select(*PAGE_COLUMNS)
            .orderBy(F.desc_nulls_first("activation_time"), F.asc("id")).offset(offset).limit(limit))


def relevance_order(keyword: str | None) -> list[Column]:
    """Title hit before description-only hit, then newest (NULLs last)."""
    if not keyword:
        return [F.desc_nulls_last("activation_time")]
    hit = F.when(F.col("title").ilike(f"%{keyword}%"), 0).otherwise(1)
    return [hit.asc(), F.desc_nulls_last("activation_time")]


def search_order(sort: str | None, keyword: str | None) -> list[Column]:
    if sort == "date":
        order = [F.desc_nulls_last("activation_time")]
    elif sort == "company":
        order = [F.asc_nulls_last("company_name_en"), F.asc_nulls_last("company_name_fa")]
    elif sort == "relevance":
        order = relevance_order(keyword)
    else:
        order = []  # unknown sort: the reference leaves order open; the id makes it stable
    return order + [F.asc("id")]


def search_filter(keyword=None, location=None, company=None, days=None, as_of=None) -> Column:
    preds = []
    if keyword:
        preds.append(FL.keyword_any(keyword))
    if location:
        preds.append(FL.location_text(location))
    if company:
        preds.append(FL.company_like(company, both=True))
    if days and str(days).isdigit():
        preds.append(FL.posted_within_days(days, as_of))
    return FL.all_of(preds)


def search(df: DataFrame, keyword=None, location=None, company=None, days=None, sort="date",
           page: int = 1, limit: int = 25, as_of=None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of results and the total count (two lazy frames over one filter)."""
    limit = page_size(limit, most)
    page = max(1, int(page))
    hits = df.where(search_filter(keyword, location, company, days, as_of))
    page_df = hits.orderBy(*search_order(sort, keyword)).offset((page - 1) * limit).limit(limit)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return page_df, total


def search_after(hits: DataFrame, cursor, limit: int = 25, most: int | None = None) -> DataFrame:
    """R03 keyset paging for the date sort (``activation_time DESC NULLS LAST,
    id ASC``): the rows after ``cursor = (activation_time, id)`` of the last
    row shown.  Unlike ``offset``, the work per page does not grow with the
    page number, and the time predicate can reach the parquet scan."""
    ts, key = F.col("activation_time"), F.col("id")
    c_ts, c_id = cursor
    if c_ts is None:
        after = ts.isNull() & (key > F.lit(c_id))
    else:
        lit_ts = F.lit(c_ts).cast("timestamp_ntz")
        after = (ts < lit_ts) | ((ts == lit_ts) & (key > F.lit(c_id))) | ts.isNull()
    limit = page_size(limit, most)
    return hits.where(after).orderBy(F.desc_nulls_last("activation_time"), F.asc("id")).limit(limit)


def page_info(total: DataFrame, page: int, limit: int, window: int = 2, most: int | None = None) -> DataFrame:
    """``total_pages = ceil(total / limit)`` and the
    page-number window of +-2 around the current page."""
    limit = page_size(limit, most)
    pages = F.ceil(F.col("total") / F.lit(limit)).cast("long")
    lo = F.greatest(F.lit(1), F.lit(page - window))
    hi = F.least(pages, F.lit(page + window))
    return total.select(
        "total", F.lit(page).alias("page"), F.lit(limit).alias("per_page"), pages.alias("total_pages"),
        F.when(hi >= lo, F.array_join(F.sequence(lo.cast("long"), hi.cast("long")), ",")).otherwise(F.lit(""))
        .alias("page_window"))


def recent_batches(ledger_state: DataFrame, n: int = 20, col: str = "start_time") -> DataFrame:
    """Last ``n`` batches by date."""
    return ledger_state.orderBy(F.desc_nulls_last(col), F.desc("batch_id")).limit(n)


def parsed_json_columns(df: DataFrame, cols=JSON_COLUMNS) -> DataFrame:
    """JSON text columns parsed on read into VARIANT; a failed parse keeps
    the text (as a VARIANT string)."""
    out = {}
    for c in cols:
        s = F.col(c)
        as_text = F.try_variant_get(F.try_parse_json(F.to_json(F.array(s))), "$[0]", "variant")
        out[c] = F.coalesce(F.try_parse_json(s), as_text)
    return df.withColumns(out)

