"""Gap-free numbers for keys, stable over replays (A23), and tables moved through them.

The numbers given so far are a small table of epochs (key, number).  Keys that
it lacks are numbered in their own order from ``next_sequence`` on: counts per
range partition and offsets, no window over all rows.  A replayed batch finds
its keys numbered and adds none; a job that dies leaves an epoch that does not
count, and the next attempt replaces it.  One job at a time writes a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import epochs as EP
from .aggregates import next_sequence
from .merge import delete_by_id
from .rows import dedupe_last, prefix_agg


def number_keys(keys: DataFrame, key: str, root: str) -> DataFrame:
    """All (key, number) pairs under ``root``, after the new ones of ``keys`` got theirs; a null key gets none."""
    spark = keys.sparkSession
    fresh, first = keys.select(key).where(F.col(key).isNotNull()).distinct(), 1
    if EP.finished(spark, root):
        given = numbers(spark, root)
        fresh = delete_by_id(fresh, given, key)
        first = next_sequence(given, "number").first()["next_id"]
    counted = prefix_agg(fresh, [key], {"number": (F.lit(1).cast("long"), "sum")})
    counted.select(key, (F.col("number") + (first - 1)).alias("number")).write.mode("overwrite").parquet(
        f"{root.rstrip('/')}/epoch={EP.next_epoch(spark, root)}")
    return numbers(spark, root)


def numbers(spark: SparkSession, root: str) -> DataFrame:
    return EP.read(spark, root).drop("epoch")


def migrate_tables(jobs: DataFrame, tags: DataFrame, job_tags: DataFrame, root: str, migrated) -> dict[str, DataFrame]:
    """Jobs, tags and their bridge under new numbers.

    ``migrated`` maps old job rows to new ones (one output row per input row,
    with ``source_id``; the old ``id`` is carried beside it).  Of jobs with one
    ``source_id``, and of tags with one name, the row of the greatest old id
    stays; bridge rows of all of them lead to its number.  A bridge row whose job or tag is
    not among the old rows is no link: it is in ``orphans`` with what it lacks.
    """
    text = {k: F.col(k).cast("string") for k in ("job_id", "tag_id")}
    moved = migrated(jobs)
    job_numbers = number_keys(moved, "source_id", f"{root}/jobs")
    named = tags.select(F.col("id").cast("string").alias("tag_id"), "name",
                        F.coalesce(F.col("description"), F.lit("")).alias("description") if "description" in tags.columns
                        else F.lit("").alias("description"))
    tag_numbers = number_keys(named, "name", f"{root}/tags")

    old_jobs = moved.select(F.col("old_id").alias("job_id"), "source_id").distinct().join(
        job_numbers, "source_id").select("job_id", F.col("number").alias("_job"))
    old_tags = named.select("tag_id", "name").distinct().join(tag_numbers, "name").select("tag_id", F.col("number").alias("_tag"))
    bridge = job_tags.select(*[c.alias(k) for k, c in text.items()]).distinct().join(
        old_jobs, "job_id", "left").join(old_tags, "tag_id", "left")
    lacks = F.concat_ws(" ", F.when(F.col("_job").isNull(), "job"), F.when(F.col("_tag").isNull(), "tag"))
    return {
        "jobs": dedupe_last(moved, "source_id", ("old_id",)).join(job_numbers, "source_id").withColumnRenamed(
            "number", "id").drop("old_id"),
        "tags": dedupe_last(named, "name", ("tag_id",)).join(tag_numbers, "name").select(
            F.col("number").alias("id"), "name", "description"),
        "job_tags": bridge.where(F.col("_job").isNotNull() & F.col("_tag").isNotNull()).select(
            F.col("_job").alias("job_id"), F.col("_tag").alias("tag_id")).distinct(),
        "orphans": bridge.where(F.col("_job").isNull() | F.col("_tag").isNull()).select("job_id", "tag_id", lacks.alias("lacks")),
    }
