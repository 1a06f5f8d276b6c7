"""Exact grouped quantiles without buffering a group in one task.

``percentile`` keeps every value of a group in one aggregation buffer, which
fails when one group holds a third of all rows.  Here the values are range
partitioned on ``(keys, value)`` so a hot group is split over many tasks,
sorted inside each partition, numbered with ``monotonically_increasing_id``
(ids increase along a partition) and checkpointed once.  A small table of (partition, group) block
sizes gives every block its global offset, which turns the wanted order
statistics into exact (partition, id) pairs; only those rows are joined out.
Interpolation is linear, as SQL ``percentile`` / ``quantile_cont``.
"""

from __future__ import annotations

import functools
import operator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, work_path

#: Of percentile_approx: a quantile's rank is off by at most 1 / ACCURACY of the group's rows.
ACCURACY = 10_000


def _null_safe_on(left: str, right: str, cols: list[str]):
    """Null-safe equality on alias-qualified names (both sides share lineage)."""
    conds = [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in cols]
    return functools.reduce(operator.and_, conds)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs, num_partitions: int | None = None
                    ) -> DataFrame:
    """Return ``keys..., p, q``: the exact ``p``-quantile of ``value`` per group."""
    return quantiles_and_ranked(df, keys, value, probs, num_partitions)[0]


def quantiles_and_ranked(df: DataFrame, keys: list[str], value: str, probs, num_partitions: int | None = None
                         ) -> tuple[DataFrame, DataFrame]:
    """As ``exact_quantiles``, also returning the checkpointed ``keys, _v`` rows
    so callers can take other statistics from the same materialised values."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())
    # The seeded tie-breaker lets the range partitioner split even a hot group
    # whose values are all equal.  The range partitioner samples its input
    # before shuffling it, so the (narrow) input is persisted: derived once,
    # and the tie-breaker stays the same for both passes.
    base = base.withColumn("_t", F.rand(17)).persist(StorageLevel.MEMORY_AND_DISK)
    ranked = (base.repartitionByRange(n, *[F.col(k) for k in keys], F.col("_v"), F.col("_t"))
              .sortWithinPartitions(*keys, "_v", "_t")
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_idx", F.monotonically_increasing_id()))
    # Partition ids and row ids must be identical in both uses below, even if
    # a branch is re-planned or an executor is lost: materialise them once in
    # the shared checkpoint folder (reliable checkpoint, lineage cut).
    checkpoint_root(spark)
    cached = ranked.persist(StorageLevel.MEMORY_AND_DISK)  # checkpointing an unpersisted frame computes it twice
    ranked = cached.checkpoint(eager=True)
    cached.unpersist()
    base.unpersist()

    blocks = ranked.groupBy("_pid", *keys).agg(F.min("_idx").alias("_first"),
                                               F.count(F.lit(1)).alias("_cnt"))
    by_key = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
              .withColumn("_total", F.sum("_cnt").over(by_key)))

    wanted = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        frac = pos - lo
        for role, r in (("lo", lo), ("hi", hi)):
            wanted.append(F.struct(F.lit(float(p)).alias("p"), F.lit(role).alias("role"),
                                   r.cast("long").alias("r"), frac.alias("frac")))
    targets = (blocks.select("_pid", *keys, "_first", "_before", "_cnt", F.explode(F.array(*wanted)).alias("t"))
               .where((F.col("t.r") >= F.col("_before")) & (F.col("t.r") < F.col("_before") + F.col("_cnt")))
               .select("_pid", *keys, (F.col("_first") + F.col("t.r") - F.col("_before")).alias("_idx"),
                       F.col("t.p").alias("p"), F.col("t.role").alias("role"), F.col("t.frac").alias("frac")))

    t = targets.alias("t")
    r = ranked.alias("r")
    on = (_null_safe_on("r", "t", keys) & (F.col("r._pid") == F.col("t._pid"))
          & (F.col("r._idx") == F.col("t._idx")))
    picked = r.join(t, on, "inner").select(*[F.col(f"r.`{k}`").alias(k) for k in keys], F.col("t.p").alias("p"),
                                           F.col("t.role").alias("role"), F.col("t.frac").alias("frac"),
                                           F.col("r._v").alias("_v"))
    out = picked.groupBy(*keys, "p").agg(
        F.max(F.when(F.col("role") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("role") == "hi", F.col("_v"))).alias("_hi"),
        F.max("frac").alias("_frac"))
    q = out.select(*keys, "p", (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("q"))
    return q, ranked.select(*keys, "_v")


def summarised_quantiles(df: DataFrame, keys: list[str], value: str, probs, accuracy: int = ACCURACY) -> DataFrame:
    """A row per group of non-null values: ``keys``, n, least, mean, most and the array ``q`` of exact quantiles, as ``probs``.

    First pass: sketches (combined map-side) give for each quantile a bracket of
    two values that holds it.  Second pass: values outside all brackets of their
    group are only counted, by the brackets above them; those inside are counted
    by value.  So what is shuffled is a row per group and task, and the distinct
    values inside brackets, some 4 / ``accuracy`` of a group for each quantile;
    running counts over these find the wanted ranks, and linear interpolation
    the quantiles.  A rank that no bracket holds (a sketch off by more than its
    bound) is found by ``exact_quantiles`` instead.  The result is written and
    reread: it has a row per group.
    """
    spark, probs = df.sparkSession, [float(p) for p in probs]
    base = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    base = base.persist(StorageLevel.MEMORY_AND_DISK)  # two passes; lost blocks are derived again, to the same values

    def stored(frame: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, "quantiles", name)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    margin = 2.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    stats = stored(base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.avg("_v").alias("mean"), F.max("_v").alias("most"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges")), "stats")
    low = [F.when(F.lit(edges[2 * i] > 0), F.get("_edges", F.lit(2 * i))).otherwise(F.col("least")) for i in range(len(probs))]
    high = [F.when(F.lit(edges[2 * i + 1] < 1), F.get("_edges", F.lit(2 * i + 1))).otherwise(F.col("most")) for i in range(len(probs))]
    brackets = stats.select(*keys, F.array(*low).alias("_low"), F.array(*high).alias("_high"))
    joined = base.alias("b").join(brackets.alias("k"), _null_safe_on("b", "k", keys)).select(
        *[F.col(f"b.`{k}`").alias(k) for k in keys], "_v", "_low", "_high")
    inside = functools.reduce(operator.or_, [(F.col("_v") >= F.get("_low", F.lit(i))) & (F.col("_v") <= F.get("_high", F.lit(i))) for i in range(len(probs))])
    below = [F.sum(F.when(F.col("_w").isNull() & (F.col("_v") < F.get("_low", F.lit(i))), 1).otherwise(0)).alias(f"_b{i}") for i in range(len(probs))]
    counted = joined.withColumn("_w", F.when(inside, F.col("_v"))).groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_c"), *below)
    group = Window.partitionBy(*keys)
    upto = group.orderBy(F.asc_nulls_first("_w")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_w").isNotNull(), F.col("_c"))).over(upto), F.lit(0)))
    ranked = ranked.withColumns({f"_b{i}": F.max(f"_b{i}").over(group) for i in range(len(probs))})
    with_n = ranked.where(F.col("_w").isNotNull()).alias("b").join(stats.alias("k"), _null_safe_on("b", "k", keys)).select(
        *[F.col(f"b.`{k}`").alias(k) for k in keys], "_w", "_c", "_before", *[f"_b{i}" for i in range(len(probs))], "n", "least", "mean", "most",
        F.array(*low).alias("_low"), F.array(*high).alias("_high"))

    def at(i: int, rank):
        """The value of that rank (from 0) where its bracket holds it."""
        start = F.col(f"_b{i}") + F.col("_before")  # outside all brackets and below this one, and inside any bracket and below
        held = (F.col("_w") >= F.get("_low", F.lit(i))) & (F.col("_w") <= F.get("_high", F.lit(i)))
        return F.max(F.when(held & (start <= rank) & (rank < start + F.col("_c")), F.col("_w")))

    found = []
    for i, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        found += [at(i, F.floor(position)).alias(f"_lo{i}"), at(i, F.ceil(position)).alias(f"_hi{i}")]
    found = with_n.groupBy(*keys).agg(*found)
    by = stats.drop("_edges").alias("b").join(found.alias("k"), _null_safe_on("b", "k", keys), "left").select(
        *[F.col(f"b.`{k}`") for k in keys], "n", "least", "mean", "most", *[f"_{e}{i}" for i in range(len(probs)) for e in ("lo", "hi")])
    q = [F.col(f"_lo{i}") + (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, p in enumerate(probs)]
    out = stored(by.select(*keys, "n", "least", "mean", "most", F.array(*q).alias("q")), "result")
    missed = out.where(F.exists("q", lambda x: x.isNull()))
    if not missed.isEmpty():
        again = base.alias("b").join(missed.select(*keys).alias("k"), _null_safe_on("b", "k", keys), "left_semi")
        exact = exact_quantiles(again, keys, "_v", probs).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("_pq"))
        fixed = missed.drop("q").alias("b").join(exact.alias("k"), _null_safe_on("b", "k", keys)).select(
            *[F.col(f"b.`{c}`") for c in out.columns if c != "q"], F.col("_pq.q").alias("q"))
        out = stored(out.where(~F.exists("q", lambda x: x.isNull())).unionByName(fixed), "mended")
    base.unpersist()
    return out
