"""Event-time alert rules and health.

The window rules are plain DataFrame functions over an event frame, so the
same code runs on a static frame (reports, tests against DuckDB) and on a
streaming frame (after ``withWatermark`` on a TIMESTAMP column; the test
data's TIMESTAMP_NTZ is cast first, see ``as_event_time``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: alert thresholds ---------------------------------------
ERRORS_5M_MAX = 5          # > 5 errors in 5 minutes = unhealthy
ERRORS_1H_MAX = 10         # > 10 errors in 1 hour, held for 10 minutes
ERRORS_PER_MINUTE_MAX = 10  # > 10 errors per minute
NO_NEW_HOURS = 24          # no new postings in 24 hours, held for 1 hour
# --- end of fixed values --------------------------------------------------


def as_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; with the session zone at UTC the cast keeps wall time."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def _windows(df: DataFrame, time: str, length: str, slide: str | None = None) -> DataFrame:
    """Events per window.  A sliding window over a static frame counts each slide
    once and adds those counts up, so no event is copied into the windows it falls
    in; a stream counts the events themselves (its ``complete`` mode takes one aggregate)."""
    n = F.count(F.lit(1))
    if slide and not df.isStreaming:
        df = df.groupBy(F.window(time, slide).start.alias("_slot")).agg(n.alias("_n"))
        time, n = "_slot", F.sum("_n")
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return (df.groupBy(w.alias("w")).agg(n.alias("errors"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "errors"))


def errors_5m(errors: DataFrame, time: str = "ts", threshold: int = ERRORS_5M_MAX) -> DataFrame:
    """Errors per 5-minute window sliding by 1 minute; unhealthy above the threshold."""
    return _windows(errors, time, "5 minutes", "1 minute").withColumn("unhealthy", F.col("errors") > threshold)


def errors_1h(errors: DataFrame, time: str = "ts", threshold: int = ERRORS_1H_MAX) -> DataFrame:
    """Errors per hour sliding by 10 minutes; the alert holds when this
    window and the one 10 minutes earlier are both above the threshold.

    The previous window is found by an equi-join on its start time, not by
    an ordered window over all windows.
    """
    cur = _windows(errors, time, "1 hour", "10 minutes")
    prev = cur.select((F.col("window_start") + F.expr("INTERVAL 10 MINUTES")).alias("window_start"),
                      F.col("errors").alias("prev_errors"))
    j = cur.join(prev, "window_start", "left")
    return j.select("window_start", "window_end", "errors",
                    ((F.col("errors") > threshold) & (F.coalesce(F.col("prev_errors"), F.lit(0)) > threshold))
                    .alias("alert"))


def slot_counts(rows: DataFrame, time: str = "ts", minutes: int = 10) -> DataFrame:
    """Rows per ``minutes``-long slot (epoch-aligned, like Spark's windows)."""
    w = F.window(time, f"{minutes} minutes")
    return rows.groupBy(w.start.cast("timestamp_ntz").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def errors_1h_from_counts(counts: DataFrame, threshold: int = ERRORS_1H_MAX) -> DataFrame:
    """T05 from 10-minute slot counts (``slot, n``; several rows per slot are
    summed): each slot feeds the six hourly windows that contain it (a fixed
    fan-out), then the hold rule joins each window to the one 10 minutes
    earlier.  Same output as ``errors_1h`` on the raw events."""
    per = counts.groupBy("slot").agg(F.sum("n").alias("n"))
    fan = per.select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "slot", "n")
    cur = (fan.select((F.col("slot") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("k") * 10)).alias("window_start"),
                      "n")
           .groupBy("window_start").agg(F.sum("n").cast("long").alias("errors"))
           .withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 1 HOUR")))
    prev = cur.select((F.col("window_start") + F.expr("INTERVAL 10 MINUTES")).alias("window_start"),
                      F.col("errors").alias("prev_errors"))
    j = cur.join(prev, "window_start", "left")
    return j.select("window_start", "window_end", "errors",
                    ((F.col("errors") > threshold) & (F.coalesce(F.col("prev_errors"), F.lit(0)) > threshold))
                    .alias("alert"))


def stream_slot_counts(stream: DataFrame, counts_path: str, checkpoint: str, time: str = "ts",
                       minutes: int = 10):
    """T05 on a stream: each micro-batch writes its slot counts under its own
    epoch folder (a replay overwrites itself); ``errors_1h_from_counts`` over
    that folder is the current window and alert table."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        slot_counts(batch, time, minutes).write.mode("overwrite").parquet(f"{counts_path}/epoch={epoch_id}")

    q = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def error_burst(errors: DataFrame, time: str = "ts", threshold: int = ERRORS_PER_MINUTE_MAX) -> DataFrame:
    """Tumbling 1-minute windows above the per-minute threshold."""
    return _windows(errors, time, "1 minute").withColumn("burst", F.col("errors") > threshold)


def hourly_counts(rows: DataFrame, time: str = "ts") -> DataFrame:
    """Rows per calendar hour (a two-phase aggregate; output size = hours)."""
    hour = F.date_trunc("HOUR", F.col(time)).cast("timestamp_ntz")
    return rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def no_new_from_counts(counts: DataFrame, hours: int = NO_NEW_HOURS) -> DataFrame:
    """T06 over hourly counts (``hour, n``; several rows per hour are summed).

    The calendar covers the observed span (one row per hour, bounded by
    time, not by data volume), left-joined to the counts.
    """
    counts = counts.groupBy("hour").agg(F.sum("n").alias("n"))
    span = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    per = cal.join(counts, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    trailing = Window.orderBy("hour").rowsBetween(-(hours - 1), 0)
    per = per.withColumn("recent", F.sum("n").over(trailing).cast("long"))
    per = per.withColumn("prev_recent", F.lag("recent").over(Window.orderBy("hour")))
    return per.select("hour", F.col("n").cast("long").alias("n"), "recent",
                      ((F.col("recent") == 0) & (F.coalesce(F.col("prev_recent"), F.lit(1)) == 0)).alias("alert"))


def no_new_24h(new_rows: DataFrame, time: str = "ts", hours: int = NO_NEW_HOURS) -> DataFrame:
    """Per calendar hour, postings in the trailing ``hours`` hours; the
    alert holds when that count is 0 now and one hour earlier."""
    return no_new_from_counts(hourly_counts(new_rows, time), hours)


def stream_no_new(stream: DataFrame, counts_path: str, checkpoint: str, time: str = "ts",
                  hours: int = NO_NEW_HOURS):
    """T06 on a stream: each micro-batch adds its hourly counts under its own
    epoch folder (a replayed epoch overwrites itself), and the rule is
    evaluated over the hourly table, which grows with time, not with data.
    Returns the finished query; ``no_new_from_counts(read(counts_path))`` is
    the current alert table."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        hourly_counts(batch, time).write.mode("overwrite").parquet(f"{counts_path}/epoch={epoch_id}")

    q = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def health_status(errors5: DataFrame, stale: DataFrame) -> DataFrame:
    """Per 5-minute window: unhealthy on an error alert, degraded when
    ingest is stale in that hour, else healthy."""
    st = stale.select(F.col("hour"), F.col("alert").alias("stale"))
    j = errors5.join(st, F.date_trunc("HOUR", F.col("window_end")).cast("timestamp_ntz") == st["hour"], "left")
    status = (F.when(F.col("unhealthy"), F.lit("unhealthy"))
              .when(F.coalesce(F.col("stale"), F.lit(False)), F.lit("degraded")).otherwise(F.lit("healthy")))
    return j.select("window_start", "window_end", "errors", status.alias("status"))


def batch_throughput(state: DataFrame) -> DataFrame:
    """Rows per second per batch, from the ledger state."""
    return state.select("batch_id", "row_count", "processing_time",
                        F.round(F.try_divide(F.col("row_count").cast("double"), F.col("processing_time")), 3)
                        .alias("rows_per_second"))
