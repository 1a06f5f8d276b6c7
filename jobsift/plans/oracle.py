"""DuckDB-dialect building blocks for the oracle SQL texts.

These are written independently of the Spark operators (JSON paths through
DuckDB's own functions) so the comparison checks semantics, not one shared
expression tree.
"""

from __future__ import annotations

from . import binding as B

# Derived columns of a posting (the trigger logic), DuckDB dialect.
_IS_ARR = "json_type({c}) = 'ARRAY'"


def _flag(tag: str) -> str:
    return (f"CASE WHEN {_IS_ARR.format(c='p.tags')} AND list_contains(from_json(p.tags, '[\"VARCHAR\"]'), '{tag}') "
            f"THEN 1 ELSE 0 END")


def derived_sql(src: str = "postings") -> str:
    from ..functions.derived import TAG_FLAGS
    flags = ",\n       ".join(f"{_flag(t)} AS {name}" for name, t in TAG_FLAGS.items())
    jpc = "p.job_post_categories"
    n = f"CASE WHEN {_IS_ARR.format(c=jpc)} THEN json_array_length({jpc}) END"
    return f"""
SELECT p.*,
       {flags},
       json_extract_string(p.raw_data, '$.jobBoard.titleEn') AS jobBoard_titleEn,
       json_extract_string(p.raw_data, '$.jobBoard.titleFa') AS jobBoard_titleFa,
       CASE WHEN {_IS_ARR.format(c='p.locations')} THEN json_extract_string(p.locations, '$[0].city.titleEn') END AS primary_city,
       CASE WHEN {_IS_ARR.format(c='p.work_types')} THEN json_extract_string(p.work_types, '$[0].titleEn') END AS work_type,
       CASE WHEN {n} = 1 THEN json_extract_string({jpc}, '$[0].titleEn')
            WHEN {n} >= 2 THEN json_extract_string({jpc}, '$[1].titleEn') END AS category,
       CASE WHEN {n} >= 2 THEN json_extract_string({jpc}, '$[0].titleEn') END AS parent_cat,
       CASE WHEN {n} >= 2 THEN json_extract_string({jpc}, '$[1].titleEn') END AS sub_cat
FROM {src} p
"""


def with_views(*names: str, derived: bool = False, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause for the oracle: binding views, optionally ``postings_d``
    (postings + derived columns) and extra CTEs, in order."""
    needed = list(names)
    if derived and "postings" not in needed:
        needed.insert(0, "postings")
    head = B.cte(*needed)
    parts = []
    if derived:
        parts.append(f"postings_d AS ({derived_sql()})")
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    if parts:
        head = head.rstrip("\n") + ",\n" + ",\n".join(parts) + "\n"
    return head


AS_OF = "(SELECT max(activation_time) FROM postings)"

# Salary value (C20 midpoint) in DuckDB: numeric bounds that are non-zero, or
# non-blank strings that parse as numbers.
def _bound(key: str, src: str = "p.salary") -> str:
    t = f"json_type({src}, '$.{key}')"
    return (f"CASE WHEN {t} = 'VARCHAR' AND length(json_extract_string({src}, '$.{key}')) > 0 "
            f"THEN TRY_CAST(trim(json_extract_string({src}, '$.{key}')) AS DOUBLE) "
            f"WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN nullif(CAST(json_extract({src}, '$.{key}') AS DOUBLE), 0) END")


def salary_bounds(src: str = "p.salary") -> tuple[str, str]:
    obj = f"coalesce(CASE WHEN json_valid({src}) THEN json_type({src}) = 'OBJECT' END, false)"
    return (f"CASE WHEN {obj} THEN {_bound('min', src)} END", f"CASE WHEN {obj} THEN {_bound('max', src)} END")


def salary_value(src: str = "p.salary") -> str:
    lo, hi = salary_bounds(src)
    return f"CASE WHEN ({lo}) IS NOT NULL AND ({hi}) IS NOT NULL THEN (({lo}) + ({hi})) / 2 ELSE coalesce({lo}, {hi}) END"
