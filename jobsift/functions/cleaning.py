"""Column-level cleaning and normalisation rules.

Untrusted input never goes through ``cast`` (ANSI mode would fail the task);
``try_*`` functions return NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted timestamp shapes and defaults -----------------
# Collect-time formats: ISO with fraction + Z, ISO + Z, "yyyy-MM-dd HH:mm:ss", date.
COLLECT_TS_SHAPE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z| \d{2}:\d{2}:\d{2})?$"
# Database-path formats: ISO with fraction, with seconds, with minutes; no zone.
DB_TS_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"
# Import formats: the database-path shapes, then ISO with an offset.
IMPORT_TS_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2}|Z)?$"
DEFAULT_SOURCE = "api_scraper"
MAX_DESCRIPTION = 65535
# --- end of fixed values --------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_text(c) -> Column:
    """C17: strip; non-strings are stringified first."""
    return F.trim(_c(c).cast("string"))


def parse_timestamp(c, shape: str = COLLECT_TS_SHAPE) -> Column:
    """C18 (reader form): first matching shape -> TIMESTAMP_NTZ, else NULL."""
    s = F.trim(_c(c).cast("string"))
    return F.when(s.rlike(shape), F.try_to_timestamp(s).cast("timestamp_ntz"))


def iso_text(ts) -> Column:
    """ISO-8601 text of a timestamp (fraction only when non-zero)."""
    ts = _c(ts)
    micros = (F.unix_micros(ts.cast("timestamp")) % 1000000).cast("long")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def normalize_timestamp_text(c, shape: str = COLLECT_TS_SHAPE) -> Column:
    """C18 (cleaner form): parsed -> ISO text, unparseable -> original string."""
    parsed = parse_timestamp(c, shape)
    return F.when(parsed.isNull(), _c(c).cast("string")).otherwise(iso_text(parsed))


def normalize_locations(c, parsed: Column | None = None) -> Column:
    """C19 as JSON text: null -> ``[]``; JSON text is kept as what it parses to
    (an object stays an object, and validation then rejects it); text that is
    not JSON -> ``[text]``.  ``parsed`` is the text's variant where it is at hand."""
    s = _c(c).cast("string")
    return (F.when(s.isNull(), F.lit("[]"))
            .when((F.try_parse_json(s) if parsed is None else parsed).isNull(), F.to_json(F.array(s)))
            .otherwise(s))


def _bound(v: Column, key: str) -> Column:
    """A truthy ``min``/``max`` as double; numeric zero and blank strings ignored."""
    item = F.try_variant_get(v, f"$.{key}", "variant")
    kind = F.schema_of_variant(item)
    as_text = F.try_variant_get(v, f"$.{key}", "string")
    as_num = F.try_variant_get(v, f"$.{key}", "double")
    return (F.when(kind == "STRING", F.when(F.length(as_text) > 0, F.trim(as_text).try_cast("double")))
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
                  | kind.startswith("DECIMAL"), F.nullif(as_num, F.lit(0.0))))


def salary_bounds_frame(df, salary: str = "salary", keep=()):
    """Normalised salary bounds as columns ``salary_min`` / ``salary_max``.

    The JSON text is parsed once in its own projection and each bound's type
    is read once in the next, so no parse is repeated inside ``CASE``
    branches (Catalyst does not share work across branches).
    """
    keep = list(keep)
    v = df.select(*keep, F.try_parse_json(F.col(salary).cast("string")).alias("_sv"))
    v = v.select(*keep, *[c.alias(n) for n, c in bound_parts("_sv").items()])
    return v.select(*keep, bound_of("min").alias("salary_min"), bound_of("max").alias("salary_max"))


def bound_parts(v: str) -> dict[str, Column]:
    """Of a parsed salary what ``bound_of`` needs in the next projection: whether it is an object, and each bound's type, text and number."""
    parts = {"_obj": F.schema_of_variant(v).startswith("OBJECT")}
    for k in ("min", "max"):
        parts |= {f"_t{k}": F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")),
                  f"_s{k}": F.try_variant_get(v, f"$.{k}", "string"), f"_d{k}": F.try_variant_get(v, f"$.{k}", "double")}
    return parts


def bound_of(k: str) -> Column:
    """The bound ``min`` or ``max`` from the columns of ``bound_parts``."""
    kind, txt, num = F.col(f"_t{k}"), F.col(f"_s{k}"), F.col(f"_d{k}")
    val = (F.when(kind == "STRING", F.when(F.length(txt) > 0, F.trim(txt).try_cast("double")))
           .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
                 F.nullif(num, F.lit(0.0))))
    return F.when(F.col("_obj"), val)


def normalize_salary(c, parsed: Column | None = None) -> dict[str, Column]:
    """C20: salary text -> JSON object text (``{"raw": text}`` when unparseable)
    plus normalised numeric bounds.  ``parsed`` is the text's variant where it is at hand."""
    s = _c(c).cast("string")
    v = F.try_parse_json(s) if parsed is None else parsed
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    text = (F.when(s.isNull() | (s == ""), s)
            .when(v.isNull(), F.to_json(F.struct(s.alias("raw"))))
            .otherwise(s))
    return {
        "salary": text,
        "normalize_salary_min": F.when(is_obj, _bound(v, "min")),
        "normalize_salary_max": F.when(is_obj, _bound(v, "max")),
    }


def canonical_salary(c) -> Column:
    """Blank -> ``''``; objects (with or without min/max/text) and lists
    stay JSON text in their original key order; other text unchanged."""
    s = _c(c).cast("string")
    return F.when(s.isNull() | (F.trim(s) == ""), F.lit("")).otherwise(s)


def fix_url(c, always_prefix: bool = False) -> Column:
    """Add an https scheme; ``//x`` gets ``https:``."""
    s = _c(c)
    if always_prefix:
        return F.when(s.isNotNull(), F.concat(F.lit("https://"), s))
    has_scheme = s.startswith("http://") | s.startswith("https://")
    return (F.when(s.isNull() | has_scheme, s)
            .when(s.startswith("//"), F.concat(F.lit("https:"), s))
            .otherwise(F.concat(F.lit("https://"), s)))


def truncate_description(c, limit: int = MAX_DESCRIPTION) -> Column:
    """Stringify and cut at 65,535 characters."""
    return F.left(_c(c).cast("string"), F.lit(limit))


def default_source(c, name: str = DEFAULT_SOURCE) -> Column:
    """Missing or empty source -> configured name."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(name))


def surrogate_id(id_col, title="title", url="url") -> Column:
    """Missing or empty id -> md5(title + '-' + url)."""
    gen = F.md5(F.concat_ws("-", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(url), F.lit(""))))
    return F.coalesce(F.nullif(_c(id_col).cast("string"), F.lit("")), gen)


def content_hash(title="title", url="url") -> Column:
    """Content key used by content-based dedupe."""
    return F.md5(F.concat_ws("-", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(url), F.lit(""))))


def cast_id(c) -> Column:
    """Numeric ids become strings."""
    return _c(c).cast("string")
