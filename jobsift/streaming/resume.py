"""Where a run goes on after a stop.

The landing index tells which pages of a source have arrived, in which file and
when.  A run that starts within ``within`` of a source's last arrival goes on
``look_back`` pages before its last page; a later one starts afresh at page 1.
Replayed pages are stored again by key, so they change nothing that is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the rules for resuming a run ---
MAX_AGE = "24 hours"
LOOK_BACK = 5
# --- end of fixed values ---


def landing_index(spark: SparkSession, landing: str) -> DataFrame:
    """Pages of a landing folder: page, file, arrival (the file's time).  Only the page number is parsed."""
    return spark.read.schema("page long").json(landing).where(F.col("page").isNotNull()).select(
        "page", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("arrival"))


def resume_plan(index: DataFrame, now, source: str = "source", page: str = "page", arrival: str = "arrival",
                within: str = MAX_AGE, look_back: int = LOOK_BACK) -> DataFrame:
    """Per source, of what arrived up to ``now``: last page, last arrival, whether the run resumes, and its first page."""
    now = F.lit(now).cast("timestamp_ntz")
    held = index.where(F.col(arrival) <= now).groupBy(source).agg(
        F.max(page).alias("last_page"), F.max(arrival).alias("last_updated"))
    resumed = F.col("last_updated") >= now - F.expr(f"INTERVAL {within}")
    return held.select(source, "last_page", "last_updated", resumed.alias("resumed"),
                       F.when(resumed, F.greatest(F.col("last_page") - look_back, F.lit(1))).otherwise(F.lit(1)).cast("long").alias("first_page"))


def pages_to_replay(index: DataFrame, plan: DataFrame, now, source: str = "source", page: str = "page", arrival: str = "arrival") -> DataFrame:
    """Pages that arrived up to ``now`` and are taken again under the plan (one row a source: AQE broadcasts it where it is small)."""
    seen = index.where(F.col(arrival) <= F.lit(now).cast("timestamp_ntz"))
    return seen.join(plan.select(source, "first_page"), source).where(F.col(page) >= F.col("first_page")).drop("first_page")
