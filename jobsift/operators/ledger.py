"""Batch ledger and run log (L01-L03) and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_COLUMNS = ("status", "row_count", "processing_time", "error_message")


def ledger_state(events: DataFrame, key: str = "batch_id", seq: str = "event_seq", time: str = "event_time",
                 cols=LEDGER_COLUMNS) -> DataFrame:
    """Current state per batch from an append-only event log.

    Each later event overwrites only the columns it carries: per column, the
    value of the latest event where it is not NULL (``max_by`` with a NULL
    ordering for NULL values, so those rows are skipped).  A two-phase
    aggregate: a batch with many events is combined map-side.
    """
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols]
    aggs += [F.min(F.when(F.col("status") == "processing", F.col(time))).alias("start_time"),
             F.max(F.when(F.col("status").isin("completed", "failed"), F.col(time))).alias("end_time"),
             F.count(F.lit(1)).alias("events")]
    return events.groupBy(key).agg(*aggs)


def record_run(state: DataFrame) -> DataFrame:
    """One statistics row per run with defaults for missing values."""
    return state.select(
        F.col("batch_id").alias("run_id"),
        F.coalesce("start_time", "end_time").alias("run_date"),
        F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("total_jobs"),
        F.lit(0).cast("long").alias("new_jobs"),
        F.lit(0).cast("long").alias("updated_jobs"),
        (F.col("status") == "failed").cast("int").alias("errors"),
        F.coalesce(F.col("processing_time"), F.lit(0.0)).alias("duration_seconds"),
        F.coalesce(F.col("status"), F.lit("unknown")).alias("status"))


def run_history(state: DataFrame) -> DataFrame:
    """Runs with found / status / duration (end - start, seconds)."""
    dur = F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
    return state.select(F.col("batch_id").alias("run_id"), "start_time", "end_time",
                        F.col("row_count").alias("jobs_found"), "status",
                        F.round(dur / 1e6, 3).alias("duration_seconds"))


def run_statistics(pages: DataFrame, page="page", n_jobs="n_jobs", failed="failed", time="ts") -> DataFrame:
    """jobs/page, jobs/second, failed-page % (divisor at least 1), 2 decimals;
    first 10 failed pages; runtime in seconds."""
    secs = (F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / 1e6
    agg = pages.agg(
        F.count(F.lit(1)).alias("pages"), F.sum(n_jobs).cast("long").alias("jobs"),
        F.count_if(F.col(failed)).alias("failed_pages"), secs.alias("runtime_seconds"))
    # The first ten failed pages come from a bounded top-k, not a list of all failures.
    first = first_failed_pages(pages, page, failed, 10).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(page))), ",")).scalar()
    return agg.select(
        "pages", "jobs", "failed_pages", F.round("runtime_seconds", 2).alias("runtime_seconds"),
        F.round(F.col("jobs") / F.greatest(F.lit(1), F.col("pages")), 2).alias("jobs_per_page"),
        F.round(F.col("jobs") / F.greatest(F.lit(1.0), F.col("runtime_seconds")), 2).alias("jobs_per_second"),
        F.round(F.col("failed_pages") * 100.0 / F.greatest(F.lit(1), F.col("pages")), 2).alias("failed_pct"),
        F.coalesce(first, F.lit("")).alias("first_failed_pages"))


def first_failed_pages(pages: DataFrame, page="page", failed="failed", k: int = 10) -> DataFrame:
    """A16 helper without collecting a list: the first k failed pages, as a bounded top-k."""
    return pages.where(F.col(failed)).select(page).orderBy(page).limit(k)


def run_log_rollup(state: DataFrame) -> DataFrame:
    """Runs, successes, failures, last status / time / duration / error, total collected."""
    return state.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "completed").alias("successes"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.max_by("status", F.struct("start_time", "batch_id")).alias("last_status"),
        F.max("start_time").alias("last_time"),
        F.max_by("processing_time", F.struct("start_time", "batch_id")).alias("last_duration"),
        F.max_by("error_message", F.when(F.col("status") == "failed", F.struct("start_time", "batch_id")))
        .alias("last_error"),
        F.sum("row_count").cast("long").alias("total_collected"))


def batch_rollup(state: DataFrame) -> DataFrame:
    """Batches, rows, failures, mean batch time."""
    return state.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum(F.when(F.col("status") == "completed", F.col("row_count"))).cast("long").alias("rows"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.round(F.avg("processing_time"), 4).alias("mean_batch_time"))
