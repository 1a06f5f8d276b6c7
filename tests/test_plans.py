"""Plan checks on a stored postings table: filters reach the parquet scan,
projections prune the read schema, batch filters prune partitions, top-k
uses a bounded heap."""

from pyspark.sql import functions as F

from jobsift.operators import aggregates as A
from jobsift.operators import filters as FL
from jobsift.operators import rows as RW
from jobsift.plans import binding as B
from jobsift.session import work_path
from jobsift.sources import readers as RD
from compare import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(spark):
    path = work_path(spark, "test", "stored")
    B.postings(spark, SF_SMALL).write.partitionBy("batch_id").parquet(path)
    return spark.read.parquet(path)


def test_date_filter_is_pushed_and_columns_pruned(spark):
    t = _stored(spark)
    plan = _plan(t.where(FL.between_dates("1997-01-01", "1997-06-30")).select("id", "activation_time"))
    assert "PushedFilters: [IsNotNull(activation_time), GreaterThanOrEqual(activation_time" in plan
    assert "ReadSchema: struct<id:string,activation_time:timestamp_ntz>" in plan


def test_batch_filter_prunes_partitions(spark):
    t = _stored(spark)
    plan = _plan(RD.scan_filtered(t, batch_id="b3").select("id"))
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "(batch_id" in plan and "= b3)" in plan


def test_top_k_is_a_bounded_heap(spark):
    plan = _plan(A.top_cities(_stored(spark)))
    assert "TakeOrderedAndProject(limit=10" in plan


def test_running_values_have_no_global_window(spark):
    ev = B.table(spark, SF_SMALL, "events").select("event_id", "value")
    plan = _plan(RW.running_mean(ev, "value", ["event_id"]))
    # every Window is partitioned: by the bucket for the rows, none over all rows
    for line in plan.splitlines():
        if "Window [" in line and "_pid" not in line:
            assert "_w" not in line or "partition" in line.lower()
    assert "Window [sum(_v__rs" in plan and "[_pid" in plan


def test_statistics_use_partial_window_group_limit(spark):
    p = B.postings(spark, SF_SMALL)
    plan = _plan(A.job_statistics(p, A.as_of_max(p)))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.count("Expand [") == 1


def test_stored_postings_layout(spark):
    from jobsift.operators import aggregates as A
    from jobsift.sources import sinks as K
    p = B.postings(spark, SF_SMALL)
    t = spark.read.parquet(K.store_postings(p, work_path(spark, "test", "store")))
    # derived columns are plain columns now; results equal the on-the-fly form
    via_col = (t.where(F.col("primary_city").isNotNull() & (F.col("primary_city") != ""))
               .groupBy(F.col("primary_city").alias("location")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), F.asc_nulls_first("location")).limit(10))
    assert via_col.collect() == A.top_cities(p).collect()
    plan = _plan(t.where((F.col("activation_month") == "1997-03") & FL.between_dates("1997-03-01", "1997-03-15")))
    assert "PartitionFilters: [isnotnull(activation_month" in plan
    assert "GreaterThanOrEqual(activation_time" in plan
    assert t.count() == p.count()
