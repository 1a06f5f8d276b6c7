"""Equi-joins between postings and their side tables.

Join strategy is left to Catalyst and AQE: dimension sides are broadcast
only when their measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(checked at plan time from statistics and again at runtime by AQE); large
sides use a sort-merge join on the key, and AQE splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings_with_tags(postings: DataFrame, bridge: DataFrame, tags: DataFrame,
                       key: str = "id", bridge_key: str = "posting_id") -> DataFrame:
    """Each posting with its sorted tag names (``[]`` when none)."""
    known = bridge.join(tags.select(F.col("name").alias("tag_name")), "tag_name", "inner")
    per_posting = known.groupBy(bridge_key).agg(F.array_sort(F.collect_set("tag_name")).alias("tag_names"))
    j = postings.join(per_posting, postings[key] == per_posting[bridge_key], "left")
    return j.select(postings["*"], F.coalesce(F.col("tag_names"), F.array().cast("array<string>")).alias("tag_names"))


def postings_of_tag(postings: DataFrame, bridge: DataFrame, tag: str, key: str = "id",
                    bridge_key: str = "posting_id") -> DataFrame:
    """J01 inverse: the postings carrying one tag (semi-join)."""
    hits = bridge.where(F.col("tag_name") == tag).select(F.col(bridge_key).alias(key))
    return postings.join(hits, key, "left_semi")


def search_hits(searches: DataFrame, results: DataFrame, postings: DataFrame) -> DataFrame:
    """Search -> result -> posting, two inner equi-joins."""
    sr = searches.join(results, searches["search_id"] == results["search_id"], "inner").drop(results["search_id"])
    return sr.join(postings, sr["job_id"] == postings["id"], "inner")


def run_postings(postings: DataFrame, runs: DataFrame, posting_run: str = "batch_id",
                 run_key: str = "run_id", broadcast_rows: int = 100_000, pieces: int = 64) -> DataFrame:
    """Each posting with its run (1:N, left join on the run id).

    Runs are counted first (up to the bound): at most ``broadcast_rows`` are
    broadcast and no posting moves.  Of more, only the runs that a posting names
    go on, and both sides are shuffled.  A run that holds more than one in
    ``pieces`` of the postings (fewer than ``pieces`` runs can) is copied ``pieces``
    times; its postings, and those without a run, are dealt to the copies by the
    hash of the whole row.  So no other run is copied, and nothing of the runs
    is broadcast, whatever size the planner expects of them.
    """
    if runs.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return postings.join(F.broadcast(runs), postings[posting_run] == runs[run_key], "left")
    held = postings.where(F.col(posting_run).isNotNull()).groupBy(F.col(posting_run).alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    most = F.col("_n") * pieces > held.select(F.sum("_n")).scalar()
    heavy = [r["_run"] for r in held.where(most).select("_run").collect()]
    copied = F.when(F.col(run_key).isin(heavy), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    copies = (runs.join(held.select("_run"), F.col(run_key) == F.col("_run"), "left_semi")
              .withColumn("_piece_run", F.explode(copied)))
    dealt = F.col(posting_run).isNull() | F.col(posting_run).isin(heavy)
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in postings.columns]), F.lit(pieces)).cast("int")
    cut = postings.withColumn("_piece", F.when(dealt, piece).otherwise(0))
    same = (cut[posting_run] == copies[run_key]) & (cut["_piece"] == copies["_piece_run"])
    return cut.join(copies.hint("merge"), same, "left").drop("_piece", "_piece_run")


def has_tag(postings: DataFrame, bridge: DataFrame, tag_filter, key: str = "id",
            bridge_key: str = "posting_id") -> DataFrame:
    """``EXISTS`` over the posting's tags, as a left-semi join on the bridge."""
    hits = bridge.where(tag_filter).select(F.col(bridge_key).alias(key))
    return postings.join(hits, key, "left_semi")
