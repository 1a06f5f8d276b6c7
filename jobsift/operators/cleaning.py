"""Row-level validation, import normalisation, nested flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as CL
from . import filters as FL

# --- fixed values: required-field rule sets and import defaults ----------
RULES = {
    "collect": ["id", "title", "activation_time"],           # A: present (non-null)
    "collect_v2": ["id", "title", "company_name_en"],        # B: present and non-blank
    "create_api": ["title", "company", "location", "description", "url"],
    "config": ["id", "title", "posted_at"],
}
DEFAULT_TITLE = "Untitled Job"
DEFAULT_RAW = '{"imported":true}'
# --- end of fixed values --------------------------------------------------


def validate_required(df: DataFrame, cols: list[str], nonblank: bool = False) -> DataFrame:
    """Keep rows whose required columns are present (and non-blank)."""
    preds = [F.col(c).isNotNull() for c in cols]
    if nonblank:
        preds += [F.trim(F.col(c).cast("string")) != "" for c in cols]
    return df.where(FL.all_of(preds))


def reject_reason(title="title", url="url", locations="locations", kind: Column | None = None) -> Column:
    """C14: first failing rule, or NULL when the posting is valid.

    ``locations`` is JSON text: it must be a non-empty array, or plain
    (non-JSON) text; a JSON object or scalar is rejected.  ``kind`` is the type
    of the JSON (null: no JSON) where it is at hand.
    """
    loc = F.col(locations)
    if kind is None:
        parsed = F.try_parse_json(loc)
        kind = F.schema_of_variant(parsed)
    else:
        parsed = kind
    return (F.when(F.col(title).isNull(), F.lit("missing_title"))
            .when(F.col(url).isNull(), F.lit("missing_url"))
            .when(loc.isNull(), F.lit("missing_locations"))
            .when(F.trim(F.col(title)) == "", F.lit("empty_title"))
            .when(F.trim(F.col(url)) == "", F.lit("empty_url"))
            .when(parsed.isNotNull() & kind.startswith("ARRAY") & (F.json_array_length(loc) == 0),
                  F.lit("empty_locations"))
            .when(parsed.isNotNull() & ~kind.startswith("ARRAY"), F.lit("locations_not_list")))


def validate_posting(df: DataFrame, as_of=None, activation: str = "activation_time", kind: Column | None = None) -> DataFrame:
    """C14: add ``reject_reason`` and ``is_valid``; split with ``where``.

    An activation time given as text that does not parse is replaced by
    ``as_of`` instead of rejecting the posting.  ``kind`` as in ``reject_reason``.
    """
    out = df.withColumn("reject_reason", reject_reason(kind=kind)).withColumn("is_valid", F.col("reject_reason").isNull())
    if as_of is not None and activation in df.columns and isinstance(df.schema[activation].dataType, T.StringType):
        raw = F.col(activation)
        parsed = F.coalesce(CL.parse_timestamp(raw), CL.parse_timestamp(raw, CL.IMPORT_TS_SHAPE))
        as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of)
        out = out.withColumn(activation, F.when(raw.isNull(), F.lit(None).cast("timestamp_ntz"))
                             .otherwise(F.coalesce(parsed, as_of_col.cast("timestamp_ntz"))))
    return out


def clean_postings(df: DataFrame, as_of=None, source_name: str = CL.DEFAULT_SOURCE) -> DataFrame:
    """The per-record cleaning chain of the collector, without a shuffle:
    trim text (C17), normalise locations (C19) and salary (C20, C21), fix the
    URL (C22), cut the description (C23), default the source (C24), fill a
    missing id (C25), then validate (C14).

    Locations and salary are parsed once, in projections before the one that
    uses them, since Catalyst does not share work across the branches of a CASE.
    """
    columns, df, cols = df.columns, _parsed_once(df), {}
    for c in ("title", "company_name_en", "company_name_fa"):
        if c in df.columns:
            cols[c] = F.when(F.col(c).isNotNull(), CL.trim_text(c))
    if "locations" in df.columns:
        cols["locations"] = CL.normalize_locations("locations", F.col("_locations_kind"))
        # no text and no JSON are lists once they are normalised
        cols["_locations_kind"] = F.coalesce(F.col("_locations_kind"), F.lit("ARRAY"))
    if "salary" in df.columns:
        cols["salary"] = CL.canonical_salary("_salary_text")
        cols["normalize_salary_min"], cols["normalize_salary_max"] = CL.bound_of("min"), CL.bound_of("max")
    if "url" in df.columns:
        cols["url"] = CL.fix_url("url")
    if "description" in df.columns:
        cols["description"] = CL.truncate_description("description")
    src = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    cols["source"] = CL.default_source(src, source_name)
    cleaned = df.withColumns(cols)
    cleaned = cleaned.withColumn("id", CL.surrogate_id("id"))
    judged = validate_posting(cleaned, as_of, kind=F.col("_locations_kind") if "locations" in columns else None)
    return judged.drop(*[c for c in df.columns if c not in columns])


def _parsed_once(df: DataFrame) -> DataFrame:
    """The frame with helper columns read from one parse of ``locations`` and one of ``salary``."""
    given = [c for c in ("locations", "salary") if c in df.columns]
    df = df.withColumns({f"_{c}_json": F.try_parse_json(F.col(c).cast("string")) for c in given})
    found = {}
    if "locations" in given:
        found["_locations_kind"] = F.schema_of_variant("_locations_json")
    if "salary" in given:
        found["_salary_text"] = CL.normalize_salary("salary", F.col("_salary_json"))["salary"]
        found |= CL.bound_parts("_salary_json")
    return df.withColumns(found).drop(*[f"_{c}_json" for c in given])


def _json_or(c: str, default: str) -> Column:
    s = F.col(c)
    return F.when(s.isNull() | F.try_parse_json(s).isNull(), F.lit(default)).otherwise(s)


def validate_import(df: DataFrame) -> DataFrame:
    """Drop rows without id; default title; JSON text fields that do not
    parse become ``[]`` (lists), ``{}`` (salary) or ``{"imported":true}`` (raw)."""
    out = df.where(F.col("id").isNotNull() & (F.col("id").cast("string") != ""))
    cols = {"title": F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(DEFAULT_TITLE))}
    for c in ("locations", "work_types", "tags", "job_post_categories"):
        if c in df.columns:
            cols[c] = _json_or(c, "[]")
    if "salary" in df.columns:
        cols["salary"] = _json_or("salary", "{}")
    if "raw_data" in df.columns:
        cols["raw_data"] = _json_or("raw_data", DEFAULT_RAW)
    if "activation_time" in df.columns and isinstance(df.schema["activation_time"].dataType, T.StringType):
        cols["activation_time"] = CL.parse_timestamp("activation_time", CL.IMPORT_TS_SHAPE)
    return out.withColumns(cols)


def flatten_nested(df: DataFrame, null_literal: bool = True) -> DataFrame:
    """Struct / array / map columns -> JSON text (nulls kept as ``null``
    keys); scalars unchanged; a NULL value becomes the text ``null`` when
    ``null_literal`` (the database path)."""
    opts = {"ignoreNullFields": "false"}
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            j = F.to_json(F.col(f"`{f.name}`"), opts)
            cols[f.name] = F.coalesce(j, F.lit("null")) if null_literal else j
    return df.withColumns(cols)


def flatten_dotted(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs become dotted top-level columns; arrays stay."""
    def walk(dtype, path):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path

    cols = []
    for f in df.schema.fields:
        for path in walk(f.dataType, [f.name]):
            ref = ".".join(f"`{p}`" for p in path)
            cols.append(F.col(ref).alias(sep.join(path)))
    return df.select(*cols)


def clean_report(df: DataFrame, key: str = "id", order=("page", "position")) -> DataFrame:
    """Input, valid, duplicates (later arrivals of an id), invalid (first
    arrivals failing C14).

    Per-id state is a two-phase aggregate (``min_by`` over the arrival order),
    so a hot id is combined map-side instead of sorted in one task.
    """
    arrival = F.struct(*[F.col(c) for c in order])
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                 F.min_by(reject_reason().isNull(), arrival).alias("_ok"))
    return per_id.agg(
        F.sum("_n").cast("long").alias("input"),
        F.count_if(F.col("_ok")).alias("valid"),
        F.sum(F.col("_n") - 1).cast("long").alias("duplicates"),
        F.count_if(~F.col("_ok")).alias("invalid"))
