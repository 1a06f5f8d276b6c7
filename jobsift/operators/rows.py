"""Row-order logic: dedupe, retention, running values, streaks.

Two scale rules shape this module:

* Keep-first / keep-last per key are two-phase aggregates (``min_by`` /
  ``max_by`` over the arrival order), never a ``row_number`` window: a key
  holding a third of all rows is combined map-side, not sorted in one task.
* Running values over one global order (running mean, streaks, stop pages)
  never use an unpartitioned window.  ``prefix_agg`` cuts the order into
  deterministic range buckets, computes per-bucket totals, turns them into
  offsets in a table with one row per bucket (a proven size bound, so it is
  broadcast), and finishes with a window local to each bucket.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

from ..functions import cleaning as CL
from ..functions import derived as D


def _keep(df: DataFrame, key: str, order: list[Column], pick) -> DataFrame:
    cols = df.columns
    packed = F.struct(*[F.col(f"`{c}`") for c in cols])
    agg = df.groupBy(key).agg(pick(packed, F.struct(*order)).alias("_row"))
    # Keep the grouping column as the key: the result stays partitioned on it.
    return agg.select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in cols])


def dedupe_first(df: DataFrame, key: str = "id", order=("page", "position")) -> DataFrame:
    """First row per key in arrival order (config name ``id_based``)."""
    return _keep(df, key, [F.col(c) for c in order], F.min_by)


def dedupe_last(df: DataFrame, key: str = "id", order=("page", "position")) -> DataFrame:
    """Last row per key wins; rows without a key are dropped."""
    return _keep(df.where(F.col(key).isNotNull()), key, [F.col(c) for c in order], F.max_by)


def dedupe_content(df: DataFrame, order=("page", "position"), title="title", url="url") -> DataFrame:
    """First row per content hash md5(title-url) (config ``content_based``)."""
    keyed = df.withColumn("_content", CL.content_hash(title, url))
    return _keep(keyed, "_content", [F.col(c) for c in order], F.min_by).drop("_content")


def duplicate_count(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows beyond the first per key (two-phase count per key)."""
    return df.groupBy(key).count().agg(F.sum(F.col("count") - 1).cast("long").alias("duplicates"))


def prefix_agg(df: DataFrame, order: list[str], aggs: dict[str, tuple[Column, str]],
               num_partitions: int | None = None) -> DataFrame:
    """Add running aggregates over one global order, without a global window.

    ``aggs`` maps output name -> (value column, "sum" | "max").  Running values
    include the current row (``ROWS UNBOUNDED PRECEDING .. CURRENT ROW``).
    Rows are range-partitioned on the full order (plus a seeded tie-breaker,
    so even a heavily repeated order value is split over tasks) and the
    partition ids are materialised once with a reliable checkpoint, so both
    uses below agree even after a retry.  Each partition is finished by a
    local window, shifted by the totals of the partitions before it (one row
    per partition, so that table is small by construction).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vals = {f"_v_{k}": v for k, (v, _) in aggs.items()}
    keyed = df.withColumns(vals).withColumn("_t", F.rand(23))
    ranged = (keyed.repartitionByRange(n, *[F.col(c) for c in order], F.col("_t"))
              .withColumn("_pid", F.spark_partition_id()))
    checkpoint_root(spark)
    cached = ranged.persist(StorageLevel.MEMORY_AND_DISK)  # checkpointing an unpersisted frame computes it twice
    ranged = cached.checkpoint(eager=True)
    cached.unpersist()
    fn = {"sum": F.sum, "max": F.max}
    totals = ranged.groupBy("_pid").agg(*[fn[how](f"_v_{k}").alias(f"_t_{k}") for k, (_, how) in aggs.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[fn[how](f"_t_{k}").over(before).alias(f"_o_{k}")
                                      for k, (_, how) in aggs.items()])
    local = Window.partitionBy("_pid").orderBy(*order, "_t").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"_l_{k}": fn[how](f"_v_{k}").over(local) for k, (_, how) in aggs.items()})
    out = out.join(F.broadcast(offsets), "_pid", "left")
    finals = {}
    for k, (_, how) in aggs.items():
        lo, off = F.col(f"_l_{k}"), F.col(f"_o_{k}")
        finals[k] = (F.coalesce(lo + off, lo) if how == "sum"
                     else F.when(off.isNull(), lo).otherwise(F.greatest(lo, off)))
    drop = [c for c in out.columns if c.startswith(("_v_", "_l_", "_o_")) or c in ("_pid", "_t")]
    return out.withColumns(finals).drop(*drop)


def running_mean(df: DataFrame, value: str, order: list[str], name: str = "running_mean") -> DataFrame:
    """Mean of ``value`` over all rows up to and including this one."""
    out = prefix_agg(df, order, {"_rs": (F.col(value).cast("double"), "sum"),
                                 "_rc": (F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long"), "sum")})
    return out.withColumn(name, F.try_divide(F.col("_rs"), F.col("_rc"))).drop("_rs", "_rc")


def failure_streak(df: DataFrame, failed: Column, order: list[str], threshold: int = 5) -> DataFrame:
    """Consecutive failures (reset by a success) and the alert flag at ``threshold``."""
    f = failed.cast("boolean")
    out = prefix_agg(df.withColumn("_failed", f), order, {"_fails": (F.col("_failed").cast("long"), "sum")})
    out = prefix_agg(out, order, {"_at_ok": (F.when(~F.col("_failed"), F.col("_fails")).otherwise(F.lit(0)), "max")})
    streak = F.when(F.col("_failed"), F.col("_fails") - F.col("_at_ok")).otherwise(F.lit(0)).cast("long")
    return (out.withColumn("streak", streak).withColumn("alert", F.col("streak") >= threshold)
            .drop("_failed", "_fails", "_at_ok"))


def empty_page_stop(pages: DataFrame, page: str = "page", n_postings: str = "n_postings",
                    has_next: str | None = "has_next", max_empty: int | None = None) -> DataFrame:
    """Pages up to the stop page.

    ``max_empty=None`` (collector A): stop at the first page with no postings
    or ``has_next`` false.  ``max_empty=k`` (collector A0): stop after k
    consecutive empty pages, a good page resets the count.
    """
    if max_empty is None:
        stop = F.col(n_postings) == 0
        if has_next:
            stop = stop | ~F.col(has_next)
        flagged = pages.withColumn("_stop", stop)
    else:
        streaked = failure_streak(pages, F.col(n_postings) == 0, [page], threshold=max_empty)
        flagged = streaked.withColumn("_stop", F.col("alert")).drop("streak", "alert")
    first_stop = flagged.where("_stop").select(F.min(page)).scalar()
    return flagged.where(first_stop.isNull() | (F.col(page) <= first_stop)).drop("_stop")


def retention(df: DataFrame, time_col: str, keep_last: int, max_age_days: int | None, as_of) -> DataFrame:
    """Keep the newest ``keep_last`` rows by time (ties at the cut kept) and
    anything newer than ``max_age_days`` before ``as_of``.

    The cut is the k-th newest time from a bounded top-k (no global window).
    """
    kth = df.select(time_col).orderBy(F.desc_nulls_last(time_col)).limit(keep_last).select(F.min(time_col)).scalar()
    keep = F.col(time_col) >= kth
    if max_age_days is not None:
        keep = keep | (F.col(time_col) >= (as_of - F.make_dt_interval(F.lit(max_age_days))))
    return df.where(keep)


def concat_batches(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames with differing columns (missing -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_codes(df: DataFrame, codes: Column) -> DataFrame:
    """The set of codes (array column exploded, then distinct)."""
    return df.select(F.explode(codes).alias("code")).distinct()


def serialize_posting(df: DataFrame, bridge: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """C11: the API dict of a posting: fixed keys, ISO time, booleans; with a
    posting-tag bridge (ORM variant) also the sorted tag names, comma-joined."""
    d = D.derive_all(df)
    extra = []
    if bridge is not None:
        from .joins import postings_with_tags
        d = postings_with_tags(d, bridge, tags if tags is not None else bridge.select(
            F.col("tag_name").alias("name")).distinct())
        extra = [F.array_join("tag_names", ",").alias("tag_names")]
    return d.select(*extra,
        "id", "title", F.coalesce("company_name_en", "company_name_fa").alias("company"),
        F.date_format("activation_time", "yyyy-MM-dd'T'HH:mm:ss").alias("activation_time"),
        "url", F.col("primary_city").alias("location"), F.col("work_type").alias("job_type"), "category",
        (F.col("tag_remote") == 1).alias("is_remote"), (F.col("tag_part_time") == 1).alias("is_part_time"),
        (F.col("tag_internship") == 1).alias("is_internship"),
        (~(F.col("tag_no_experience") == 1)).alias("requires_experience"),
        (F.col("tag_military_exemption") == 1).alias("military_exemption"))
