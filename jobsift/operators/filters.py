"""Filters and predicates.

Every filter is a ``Column`` so callers AND them together and Catalyst pushes
the simple ones (ranges, equality, non-null) into the parquet scan.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derived as D


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def between_dates(date_from=None, date_to=None, col: str = "activation_time") -> Column:
    """``col >= from AND col <= to``; each bound optional, both inclusive."""
    preds = []
    if date_from not in (None, ""):
        preds.append(_c(col) >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to not in (None, ""):
        preds.append(_c(col) <= F.lit(date_to).cast("timestamp_ntz"))
    return all_of(preds)


def _like(text: str) -> str:
    # User text is wrapped, not escaped: % and _ typed by the user stay wildcards.
    return f"%{text}%"


def title_keyword(kw: str, col: str = "title") -> Column:
    """``title ILIKE '%kw%'``."""
    return _c(col).ilike(_like(kw))


def keyword_any(kw: str, cols=("title", "description")) -> Column:
    """keyword in title OR description."""
    return any_of([_c(c).ilike(_like(kw)) for c in cols])


def company_like(name: str, both: bool = False) -> Column:
    """English name only (repository) / English OR Persian (search)."""
    cols = ["company_name_en", "company_name_fa"] if both else ["company_name_en"]
    return any_of([_c(c).ilike(_like(name)) for c in cols])


def location_text(text: str, col: str = "locations") -> Column:
    """match anywhere in the locations JSON text, keys included."""
    return _c(col).ilike(_like(text))


def category_like(text: str, col: str = "category") -> Column:
    """``category ILIKE``."""
    return _c(col).ilike(_like(text))


def flag_filters(remote=None, no_experience=None) -> Column:
    """each flag applied only when exactly ``True``."""
    preds = []
    if remote is True:
        preds.append(_c("tag_remote") == 1)
    if no_experience is True:
        preds.append(_c("tag_no_experience") == 1)
    return all_of(preds)


def posted_within_days(days, as_of, col: str = "activation_time") -> Column:
    """``col >= as_of - N days`` when ``days`` is all digits, else no filter."""
    if days is None or not str(days).isdigit():
        return F.lit(True)
    bound = _c(as_of) - F.make_dt_interval(F.lit(int(days)))
    return _c(col) >= bound


def equals_key(col: str, value) -> Column:
    """equality on a key column (batch, company, run, status...)."""
    return _c(col) == F.lit(value)


def by_id(df: DataFrame, posting_id, col: str = "id") -> DataFrame:
    """point lookup; empty result = not found."""
    return df.where(_c(col) == F.lit(str(posting_id))).limit(1)


def nonempty_text(col) -> Column:
    """``x IS NOT NULL AND x != ''``."""
    return _c(col).isNotNull() & (_c(col) != "")


def json_text_guard(text: str, col: str = "locations") -> Column:
    """plain substring test on the JSON text before extracting from it."""
    return _c(col).contains(text)


def all_of(preds) -> Column:
    preds = list(preds)
    return functools.reduce(operator.and_, preds) if preds else F.lit(True)


def any_of(preds) -> Column:
    preds = list(preds)
    return functools.reduce(operator.or_, preds) if preds else F.lit(False)


# dict keys understood by ``filter_spec``.
_SPEC_KEYS = {"date_from", "date_to", "keywords", "keyword", "company", "company_any", "location",
              "remote", "no_experience", "category", "days", "company_id", "batch_id",
              "run_id", "status", "still_active"}


def filter_spec(spec: dict | None, as_of=None) -> Column:
    """optional filters -> AND of predicates; empty -> TRUE; ``''`` = not set.

    Unknown keys raise instead of silently shifting parameters.
    """
    spec = dict(spec or {})
    unknown = set(spec) - _SPEC_KEYS
    if unknown:
        raise KeyError(f"unknown filter keys: {sorted(unknown)}")

    def given(k):
        v = spec.get(k)
        return v is not None and v != ""

    preds = []
    if given("date_from") or given("date_to"):
        preds.append(between_dates(spec.get("date_from"), spec.get("date_to")))
    if given("keywords"):
        preds.append(title_keyword(spec["keywords"]))
    if given("keyword"):
        preds.append(keyword_any(spec["keyword"]))
    if given("company"):
        preds.append(company_like(spec["company"]))
    if given("company_any"):
        preds.append(company_like(spec["company_any"], both=True))
    if given("location"):
        preds.append(location_text(spec["location"]))
    if given("category"):
        preds.append(category_like(spec["category"]))
    preds.append(flag_filters(spec.get("remote"), spec.get("no_experience")))
    if given("days"):
        if as_of is None:
            raise ValueError("'days' needs an as_of")
        preds.append(posted_within_days(spec["days"], as_of))
    for k in ("company_id", "batch_id", "run_id", "status", "still_active"):
        if given(k):
            preds.append(equals_key(k, spec[k]))
    return all_of(preds)


def facet_filters(tags=None, locations=None, companies=None, job_types=None, remote=None) -> Column:
    """multi-valued facets; each list is OR-ed inside, facets AND-ed."""
    preds = []
    if tags:
        preds.append(F.coalesce(F.arrays_overlap(D.tags_array(), F.array(*[F.lit(t) for t in tags])),
                                F.lit(False)))
    if locations:
        preds.append(D.primary_city().isin(list(locations)))
    if companies:
        preds.append(_c("company_name_en").isin(list(companies)) | _c("company_name_fa").isin(list(companies)))
    if job_types:
        preds.append(D.work_type().isin(list(job_types)))
    if remote is not None and str(remote).lower() in ("true", "1", "yes"):
        preds.append(D.tag_flag(D.TAG_FLAGS["tag_remote"]) == 1)
    return all_of(preds)
