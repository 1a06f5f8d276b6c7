"""Aggregations.

All group-bys are two-phase hash aggregates (partial aggregation before the
shuffle), so a hot key costs one partial row per input partition, never a
whole group in one task.  Top-k reports end in ``orderBy().limit()`` which
Spark plans as ``TakeOrderedAndProject`` (a bounded heap per partition);
per-set top-k inside one query uses ``row_number() <= k``, which Spark 3.5+
turns into a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derived as D
from . import filters as FL
from .quantiles import summarised_quantiles


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_max(df: DataFrame, col: str = "activation_time") -> Column:
    """Reproducible "now": ``max(col)`` of the frame, as a scalar subquery."""
    return df.select(F.max(col)).scalar()


def day_of(c) -> Column:
    """Calendar day of a timestamp, as a TIMESTAMP_NTZ at midnight."""
    return F.date_trunc("DAY", _c(c)).cast("timestamp_ntz")


def count_postings(df: DataFrame) -> DataFrame:
    """``COUNT(*)``."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def count_filtered(df: DataFrame, spec: dict | None, as_of=None) -> DataFrame:
    """``COUNT(*)`` under a filter spec."""
    return df.where(FL.filter_spec(spec, as_of)).agg(F.count(F.lit(1)).alias("total"))


def by_day_30d(df: DataFrame, as_of, days: int = 30, col: str = "activation_time") -> DataFrame:
    """Per calendar day since ``date(as_of) - days`` (midnight bound), newest first."""
    bound = day_of(as_of) - F.make_dt_interval(F.lit(days))
    return (df.where(_c(col) >= bound).groupBy(day_of(col).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")))


def by_day_30d_rolling(df: DataFrame, as_of, days: int = 30, col: str = "activation_time") -> DataFrame:
    """As A03 but the bound is ``as_of - days`` (a partial first day)."""
    bound = _c(as_of) - F.make_dt_interval(F.lit(days))
    return (df.where(_c(col) >= bound).groupBy(day_of(col).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")))


def trend_90d(df: DataFrame, as_of, days: int = 90, col: str = "activation_time") -> DataFrame:
    """``date_trunc('day')`` counts, strictly after ``date(as_of) - days``, oldest first."""
    bound = day_of(as_of) - F.make_dt_interval(F.lit(days))
    return (df.where(_c(col) > bound).groupBy(day_of(col).alias("post_date"))
            .agg(F.count(F.lit(1)).alias("job_count")).orderBy("post_date"))


def top_k(df: DataFrame, key: Column, name: str, k: int = 10, nonempty: bool = True,
          count_name: str = "n") -> DataFrame:
    """Top-k groups by count; ties broken by key ascending (NULL first)."""
    src = df.select(key.alias(name))
    if nonempty:
        src = src.where(FL.nonempty_text(name))
    return (src.groupBy(name).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.desc(count_name), F.asc_nulls_first(name)).limit(k))


def top_companies(df, k=10):
    """Non-empty English company name, top 10."""
    return top_k(df, F.col("company_name_en"), "company", k)


def top_companies_named(df, k=10):
    """``COALESCE(en, fa, 'Unknown')``; the empty string stays a group."""
    key = F.coalesce(F.col("company_name_en"), F.col("company_name_fa"), F.lit("Unknown"))
    return top_k(df, key, "company", k, nonempty=False)


def top_job_boards(df, k=10):
    """Non-empty job board title, top 10."""
    return top_k(df, D.job_board_title_en(), "job_board", k)


def top_cities(df, k=10):
    """Non-empty primary city, top 10."""
    return top_k(df, D.primary_city(), "location", k)


def top_categories(df, k=10):
    """A10: non-empty category, top 10."""
    return top_k(df, D.category_hierarchy()["category"], "category", k)


def top_provinces(df, k=10):
    """First location's ``province.name`` under the ``'province'`` text guard;
    the NULL group is dropped after the limit."""
    src = df.where(FL.json_text_guard("province"))
    top = top_k(src, D.primary_province(), "location", k, nonempty=False)
    return top.where(F.col("location").isNotNull())


def location_distribution(df, k=10):
    """NULL or ``[]`` -> ``Unknown``, else the first location's city object as JSON text."""
    loc = F.col("locations")
    key = F.when(loc.isNull() | (loc == "[]"), F.lit("Unknown")).otherwise(F.get_json_object(loc, "$[0].city"))
    return top_k(df, key, "location", k, nonempty=False, count_name="job_count")


def category_distribution(df, k=10, col: str = "job_post_categories", field: str = "titleEn"):
    """``COALESCE(first category's name, 'Uncategorized')`` (grouped by the
    expression under a fresh alias, see D8)."""
    key = F.coalesce(F.get_json_object(F.col(col), f"$[0].{field}"), F.lit("Uncategorized"))
    return top_k(df, key, "category_name", k, nonempty=False, count_name="job_count")


def _rank_sets(out: DataFrame, k: int, day_stat: str = "by_date") -> DataFrame:
    """Rank a long ``stat, key, n`` frame: top-k per stat (count desc, key asc),
    every day (newest first), the total.

    The first window cuts each stat to k; every day is a group of its own
    there, so no day is lost and the pure filter ``rank <= k`` still lets Spark
    insert a partial ``WindowGroupLimit`` before the shuffle.  The second
    window numbers what is left: k rows per stat, and one row per day.
    """
    is_day = F.col("stat") == day_stat
    own = out.withColumn("_day", F.when(is_day, F.col("key")))
    top = Window.partitionBy("stat", "_day").orderBy(F.col("n").desc(), F.col("key").asc_nulls_first())
    cut = own.withColumn("_cut", F.row_number().over(top)).where(F.col("_cut") <= k).drop("_cut", "_day")
    w = Window.partitionBy("stat").orderBy(
        F.when(is_day, F.lit(0)).otherwise(F.col("n")).desc(),
        F.when(is_day, F.col("key")).desc_nulls_last(),
        F.when(~is_day, F.col("key")).asc_nulls_first())
    return cut.withColumn("rank", F.row_number().over(w))


def job_statistics(df: DataFrame, as_of, k: int = 10) -> DataFrame:
    """Total, by day (30 calendar days), top companies / job boards / cities /
    categories -- one scan, one grouping-sets aggregate.

    Output is long: ``stat, key, n, rank``.  Each set's own filter lives in its
    grouping key (NULL = filtered out), so no filter leaks into another set.
    """
    bound = day_of(as_of) - F.make_dt_interval(F.lit(30))
    keys = df.select(
        F.when(F.col("activation_time") >= bound, F.date_format("activation_time", "yyyy-MM-dd")).alias("k_day"),
        F.col("company_name_en").alias("k_company"),
        D.job_board_title_en().alias("k_board"),
        D.primary_city().alias("k_city"),
        D.category_hierarchy()["category"].alias("k_category"),
    )
    names = ["k_day", "k_company", "k_board", "k_city", "k_category"]
    agg = keys.groupingSets([[c] for c in names] + [[]], *names).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    # grouping_id bit i (from the left) is 1 when column i is NOT in the set.
    full = (1 << len(names)) - 1
    stat = F.when(F.col("gid") == full, F.lit("total"))
    for i, (c, label) in enumerate(zip(names, ["by_date", "by_company", "by_job_board", "by_location",
                                                "by_category"])):
        stat = stat.when(F.col("gid") == full ^ (1 << (len(names) - 1 - i)), F.lit(label))
    key = F.coalesce(*[F.col(c) for c in names])
    out = agg.select(stat.alias("stat"), key.alias("key"), "n")
    out = out.where((F.col("stat") == "total") | FL.nonempty_text("key"))
    return _rank_sets(out, k).select("stat", "key", "n", "rank")


def web_statistics(df: DataFrame, as_of, k: int = 10) -> DataFrame:
    """Total, by day (rolling 30 days), top companies (COALESCE en, fa,
    'Unknown'), top provinces -- one grouping-sets aggregate, long output."""
    bound = _c(as_of) - F.make_dt_interval(F.lit(30))
    keys = df.select(
        F.when(F.col("activation_time") >= bound, F.date_format("activation_time", "yyyy-MM-dd")).alias("k_day"),
        F.coalesce(F.col("company_name_en"), F.col("company_name_fa"), F.lit("Unknown")).alias("k_company"),
        FL.json_text_guard("province").alias("k_guard"),
        D.primary_province().alias("k_prov"),
    )
    agg = keys.groupingSets([["k_day"], ["k_company"], ["k_guard", "k_prov"], []],
                            "k_day", "k_company", "k_guard", "k_prov").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    stat = (F.when(F.col("gid") == 15, F.lit("total"))
            .when(F.col("gid") == 7, F.lit("by_date"))
            .when(F.col("gid") == 11, F.lit("by_company"))
            .when(F.col("gid") == 12, F.lit("by_location")))
    key = F.coalesce("k_day", "k_company", "k_prov")
    out = agg.select(stat.alias("stat"), key.alias("key"), "n", "k_guard")
    # by_date: NULL days are the rows outside the window; by_location: guard must hold.
    out = out.where(~((F.col("stat") == "by_date") & F.col("key").isNull()))
    out = out.where(~((F.col("stat") == "by_location") & ~F.coalesce(F.col("k_guard"), F.lit(False))))
    ranked = _rank_sets(out.drop("k_guard"), k)
    # The NULL province group counts towards the top 10 but is not reported.
    ranked = ranked.where(~((F.col("stat") == "by_location") & F.col("key").isNull()))
    return ranked.select("stat", "key", "n", "rank")


def salary_value(salary: str = "salary") -> Column:
    """Numeric salary of a posting: midpoint of the normalised bounds present."""
    from ..functions.cleaning import normalize_salary
    ns = normalize_salary(salary)
    lo, hi = ns["normalize_salary_min"], ns["normalize_salary_max"]
    return F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(F.coalesce(lo, hi))


def salary_values(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``name, salary_value`` with the JSON parsed once per row."""
    from ..functions.cleaning import salary_bounds_frame
    b = salary_bounds_frame(df.select(key.alias(name), "salary"), keep=[name])
    lo, hi = F.col("salary_min"), F.col("salary_max")
    mid = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(F.coalesce(lo, hi))
    return b.select(name, mid.alias("salary_value")).where(F.col("salary_value").isNotNull())


def salary_summary(df: DataFrame, key: Column, name: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Count, min, mean, max and exact quartiles of the salary value per group.

    Quartiles come from ``summarised_quantiles``: brackets by sketches, then
    counts, so that no full set of values is shuffled or held by one task.
    """
    out = summarised_quantiles(salary_values(df, key, name), [name], "salary_value", probs)
    return out.select(name, "n", F.col("least").alias("min_salary"), F.round("mean", 2).alias("mean_salary"), F.col("most").alias("max_salary"),
                      *[F.round(F.get("q", F.lit(i)), 2).alias(f"p{int(round(p * 100))}_salary") for i, p in enumerate(probs)])


def salary_by_category(df: DataFrame) -> DataFrame:
    """Salary distribution per (non-NULL) category."""
    out = salary_summary(df, D.category_hierarchy()["category"], "category")
    return out.where(F.col("category").isNotNull())


def salary_by_city(df: DataFrame) -> DataFrame:
    """Salary distribution per (non-NULL) primary city."""
    out = salary_summary(df, D.primary_city(), "city")
    return out.where(F.col("city").isNotNull())


def salary_trend(df: DataFrame, col: str = "activation_time") -> DataFrame:
    """Monthly mean and median salary."""
    month = F.date_trunc("MONTH", F.col(col)).cast("timestamp_ntz")
    base = salary_values(df.where(F.col(col).isNotNull()), month, "month")
    out = summarised_quantiles(base, ["month"], "salary_value", (0.5,))
    return out.select("month", "n", F.round("mean", 2).alias("mean_salary"), F.round(F.get("q", F.lit(0)), 2).alias("median_salary"))


def activity_7d(df: DataFrame, as_of, days: int = 7, col: str = "activation_time") -> DataFrame:
    """Postings per day over the ``days`` days before ``as_of``'s day, empty days as 0."""
    end = F.to_date(_c(as_of))
    cal = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(end, days), F.date_sub(end, 1))).alias("d"))
    counts = (df.where((_c(col) >= F.date_sub(end, days).cast("timestamp_ntz")) & (_c(col) < end.cast("timestamp_ntz")))
              .groupBy(F.to_date(col).alias("d")).agg(F.count(F.lit(1)).alias("n")))
    return (cal.join(counts, "d", "left")
            .select(F.col("d").cast("timestamp_ntz").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def duration_histogram(df: DataFrame, col: str, bounds=(1, 5, 10, 30, 60, 120, 300, 600)) -> DataFrame:
    """Cumulative bucket counts ``count(v <= le)`` per bound, plus ``+Inf``."""
    aggs = [F.count_if(F.col(col) <= F.lit(float(b))).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    aggs.append(F.count(F.col(col)).alias("le_inf"))
    aggs.append(F.round(F.sum(col), 2).alias("sum"))
    return df.agg(*aggs)


# --- fixed values: histogram bounds of the two duration metrics -----------
SCRAPE_BOUNDS = (1, 5, 10, 30, 60, 120, 300, 600)
DB_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1, 5)
# --- end of fixed values --------------------------------------------------


def next_sequence(df: DataFrame, col: str) -> DataFrame:
    """``COALESCE(MAX(id), 0) + 1``."""
    return df.agg((F.coalesce(F.max(col), F.lit(0)) + 1).cast("long").alias("next_id"))


def errors_by_type(errors: DataFrame, col: str = "error_type") -> DataFrame:
    """Count per error type."""
    return errors.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def error_rate(events: DataFrame, is_error: Column) -> DataFrame:
    """Errors / (requests + 1), one pass."""
    return events.agg(F.count_if(is_error).alias("errors"), F.count(F.lit(1)).alias("requests")).select(
        "errors", "requests", F.round(F.col("errors") / (F.col("requests") + 1), 6).alias("error_rate"))


def ingest_counters(log: DataFrame, by: list[str], value: str | None = None) -> DataFrame:
    """Counters by labels (e.g. source/status), as sums over the run log."""
    agg = F.count(F.lit(1)) if value is None else F.sum(value)
    return log.groupBy(*by).agg(agg.cast("long").alias("total"))


def custom_sql(spark, views: dict[str, DataFrame], text: str, args: dict | None = None) -> DataFrame:
    """User SQL against registered views, with bound parameters."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text, args=args or None)
