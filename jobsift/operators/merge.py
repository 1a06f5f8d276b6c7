"""Upsert, delete, patch and change feed between frames.

Plain parquet has no ``MERGE INTO``; a merge is one full-outer equi-join on the
key (both sides hash-partitioned on it; AQE splits skewed partitions) whose
result the caller stores.  ``operators/epochs.py`` keeps a table on disk, batch
by batch, without that join.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_COLUMNS = ("table_name", "record_id", "action", "old_data", "new_data", "changed_by", "changed_at")
FEW_KEYS = 100_000  # once they are counted, at most so many keys are broadcast


def dedupe_batch(source: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """One row per key in the incoming batch (last arrival wins).

    Without an arrival order the largest row wins, which is deterministic
    under task retries.
    """
    cols = source.columns
    packed = F.struct(*[F.col(f"`{c}`") for c in cols])
    ordering = F.struct(*[F.col(c) for c in order]) if order else packed
    agg = source.groupBy(key).agg(F.max_by(packed, ordering).alias("_r"))
    # The key is the grouping column itself, so the output stays hash-partitioned
    # on it and a following join on the key needs no second shuffle.
    return agg.select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in cols])


def dedupe_reread(source: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """D9 as ``dedupe_batch``, for rows that are persisted or cheap to read again.

    The keys are counted first, by the key column alone.  Where none repeats the
    rows stay as they are; where few do, only theirs are aggregated and the others
    are neither sorted nor shuffled; where many do, all are aggregated.
    """
    repeated = source.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    n = repeated.count()
    if not n:
        return source
    if n > FEW_KEYS:
        return dedupe_batch(source, key, order)
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key"))
    once = source.join(F.broadcast(repeated), same, "left_anti")
    return once.unionByName(dedupe_batch(source.join(F.broadcast(repeated), same, "left_semi"), key, order))


def _q(alias: str, c: str) -> Column:
    """A column by alias-qualified name (robust when both sides share lineage)."""
    return F.col(f"{alias}.`{c}`")


def _merge_cols(key: str, given: list[str], held: list[str], now: Column, s_present: Column, t_present: Column) -> list[Column]:
    """The target's columns, then the batch's new ones.  A column that the batch
    lacks keeps the target's value (NULL in inserted rows); a new one is NULL in
    rows that the batch does not touch."""
    out = [F.coalesce(_q("s", key), _q("t", key)).alias(key)]
    for c in [*held, *[c for c in given if c not in held]]:
        if c == key:
            continue
        if c in given:
            out.append((F.when(s_present, _q("s", c)).otherwise(_q("t", c)) if c in held else _q("s", c)).alias(c))
        else:
            out.append(_q("t", c).alias(c))
    out.append(F.when(t_present, _q("t", "created_at")).otherwise(now).alias("created_at"))
    out.append(F.when(s_present, now).otherwise(_q("t", "updated_at")).alias("updated_at"))
    return out


def with_audit_columns(df: DataFrame, now) -> DataFrame:
    """Initial load: ``created_at = updated_at = now``."""
    now = F.lit(now) if not isinstance(now, Column) else now
    return df.withColumn("created_at", now.cast("timestamp_ntz")).withColumn("updated_at", now.cast("timestamp_ntz"))


def upsert(target: DataFrame, source: DataFrame, now, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """U01 + U06: matched rows take the batch's columns and ``updated_at = now``;
    ``created_at`` and the columns that the batch lacks are kept; unmatched rows
    are inserted.  ``order`` tells the last arrival among a batch's rows of one
    key; give it wherever keys can repeat."""
    now = (F.lit(now) if not isinstance(now, Column) else now).cast("timestamp_ntz")
    cols = [c for c in source.columns if c not in ("created_at", "updated_at")]
    s = dedupe_batch(source.select(*cols), key, order).alias("s")
    t = target.alias("t")
    j = t.join(s, _q("t", key) == _q("s", key), "full_outer")
    held = [c for c in target.columns if c not in ("created_at", "updated_at")]
    return j.select(*_merge_cols(key, cols, held, now, _q("s", key).isNotNull(), _q("t", key).isNotNull()))


def upsert_counts(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Inserted vs updated, computed from the merge join itself."""
    s = source.select(key).distinct().alias("s")
    t = target.select(key).alias("t")
    j = s.join(t, _q("s", key) == _q("t", key), "left")
    return j.agg(F.count_if(_q("t", key).isNull()).alias("inserted"),
                 F.count_if(_q("t", key).isNotNull()).alias("updated"))


def insert_only(target: DataFrame, source: DataFrame, now, key: str = "id") -> DataFrame:
    """``ON CONFLICT DO NOTHING``: only ids not in the target are added."""
    now = (F.lit(now) if not isinstance(now, Column) else now).cast("timestamp_ntz")
    cols = [c for c in source.columns if c not in ("created_at", "updated_at")]
    new = dedupe_batch(source.select(*cols), key).join(target.select(key), key, "left_anti")
    return target.unionByName(with_audit_columns(new, now))


def delete_by_id(target: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Remove rows whose key is in ``keys`` (anti-join)."""
    return target.join(keys.select(key), key, "left_anti")


def keys_not_in(source: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The distinct keys of ``source`` that ``keys`` lacks, as ``_key``; both are shuffled, neither is sorted or broadcast."""
    left = delete_by_id(source.select(key).distinct(), keys.hint("shuffle_hash"), key)
    return left.select(F.col(f"`{key}`").alias("_key"))


def keep_keys(target: DataFrame, keys: DataFrame, n_keys: int, key: str = "id") -> DataFrame:
    """Rows whose key is among the ``n_keys`` keys of ``keys`` (``_key``): few are
    broadcast and no row is shuffled, many meet the rows in a hash join, which sorts no row."""
    keys = F.broadcast(keys) if n_keys <= FEW_KEYS else keys.hint("shuffle_hash")
    return target.join(keys, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left_semi")


def replace_or_patch(target: DataFrame, changes: DataFrame, now, key: str = "id", mode: str = "patch",
                     required=("title", "url")) -> DataFrame:
    """PUT replaces the given columns (rows missing a required field are
    ignored); PATCH overlays the non-NULL given fields.  Only existing keys
    change; ``updated_at`` is stamped; the key is kept."""
    now = (F.lit(now) if not isinstance(now, Column) else now).cast("timestamp_ntz")
    given = [c for c in changes.columns if c != key]
    ch = changes
    if mode == "put":
        ch = ch.where(functools.reduce(operator.and_, [F.col(c).isNotNull() for c in required if c in given],
                                       F.lit(True)))
    c = dedupe_batch(ch, key).alias("c")
    t = target.alias("t")
    j = t.join(c, _q("t", key) == _q("c", key), "left")
    hit = _q("c", key).isNotNull()
    out = []
    for col in target.columns:
        if col == "updated_at":
            out.append(F.when(hit, now).otherwise(_q("t", col)).alias(col))
        elif col in given:
            new = _q("c", col) if mode == "put" else F.coalesce(_q("c", col), _q("t", col))
            out.append(F.when(hit, new).otherwise(_q("t", col)).alias(col))
        else:
            out.append(_q("t", col).alias(col))
    return j.select(*out)


def _row_json(alias: str, cols: list[str]) -> Column:
    return F.to_json(F.struct(*[_q(alias, c).cast("string").alias(c) for c in cols]), {"ignoreNullFields": "false"})


def audit_feed(old: DataFrame, new: DataFrame, at, key: str = "id", table: str = "jobs", actor: str = "system",
               include_noop: bool = False) -> DataFrame:
    """Row-level change log between two versions: INSERT (new), UPDATE
    (old + new), DELETE (old), as JSON text with table, id, actor, time.

    Unchanged rows are dropped by an exact null-safe comparison of every
    column (PostgreSQL logs no-op updates too; ``include_noop`` keeps them).
    """
    at = (F.lit(at) if not isinstance(at, Column) else at).cast("timestamp_ntz")
    cols = [c for c in old.columns if c in new.columns]
    o, n = old.alias("o"), new.alias("n")
    ok, nk = _q("o", key), _q("n", key)
    j = o.join(n, ok == nk, "full_outer")
    same = functools.reduce(operator.and_, [_q("o", c).eqNullSafe(_q("n", c)) for c in cols if c != "updated_at"])
    action = F.when(ok.isNull(), F.lit("INSERT")).when(nk.isNull(), F.lit("DELETE")).otherwise(F.lit("UPDATE"))
    out = j.select(
        F.lit(table).alias("table_name"), F.coalesce(nk, ok).alias("record_id"), action.alias("action"),
        F.when(ok.isNotNull(), _row_json("o", cols)).alias("old_data"),
        F.when(nk.isNotNull(), _row_json("n", cols)).alias("new_data"),
        F.lit(actor).alias("changed_by"), at.alias("changed_at"),
        (ok.isNotNull() & nk.isNotNull() & same).alias("_noop"))
    if not include_noop:
        out = out.where(~F.col("_noop"))
    return out.drop("_noop")


def natural_key_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Natural keys that occur more than once (a check; W01 enforces)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
