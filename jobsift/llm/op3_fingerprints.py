"""Document fingerprints (3): bottom-k sketches of shingle hashes.

A text's sketch is the ``k`` least distinct hashes (first 16 hex digits of
MD5, in their order) of its shingles of five words; a shorter text is one
shingle.  Sketches of parts merge into the sketch of the whole, and estimate
resemblance, containment and the number of distinct shingles.

Defined results: null and empty texts have the empty sketch, whose resemblance
to another empty sketch is 1 and to any other 0; equal texts have equal
sketches; an empty table gives no rows; extra columns are ignored.  The next
document follows in the order of doc_id, then text; a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import documents, free_name, let, shuffle_partitions, whole_text, words

K = 64
SHINGLE = 5
#: Buckets of ascending ids for each shuffle partition.
BUCKETS_EACH = 4
#: Ids sort below all others where they are null.
LEAST_ID = -(1 << 63)


def shingle_hashes(found: Column, n: int = SHINGLE) -> Column:
    """Hashes of the shingles of n words; all words as one if there are fewer."""

    def digest(x: Column) -> Column:
        return F.substring(F.md5(x), 1, 16)

    many = F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: digest(F.concat_ws(" ", *[F.get(found, i + k) for k in range(n)])))
    return (F.when(F.size(found) >= n, many).when(F.size(found) > 0, F.array(digest(F.array_join(found, " "))))
            .otherwise(F.array().cast("array<string>")))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The bottom-k sketch of a non-null text: ascending array of hashes."""
    return F.slice(F.array_sort(F.array_distinct(let(words(text), lambda w: shingle_hashes(w, n)))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|, 0 to 1."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.greatest(F.size(u), F.lit(1))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = F.conv(F.substring(F.get(a, F.lit(k - 1)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(last, F.lit(2.0**-52)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|, 0 to 1."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def merge_sketches(parts: DataFrame, key: str, sketches: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    The k least distinct hashes of a key are ranked with a limit before the
    shuffle, so that a key with very many parts needs no large group.
    """
    each = parts.select(F.col(key).alias("_op_key"), F.explode(sketches).alias("_op_hash")).distinct()
    ranked = each.withColumn("_op_rank", F.row_number().over(Window.partitionBy("_op_key").orderBy("_op_hash")))
    least = (ranked.where(F.col("_op_rank") <= k).groupBy("_op_key")
             .agg(F.array_sort(F.collect_list("_op_hash")).alias(sketches)))
    keys = parts.select(F.col(key).alias("_op_key")).distinct()
    return (keys.alias("k").join(least.alias("s"), F.expr("k._op_key <=> s._op_key"), "left")
            .select(F.col("k._op_key").alias(key), F.coalesce(F.col(f"s.{sketches}"), F.array().cast("array<string>")).alias(sketches)))


def with_next(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: what follows by ascending doc_id; after the last, the first.

    Ids are cut into buckets at their quantiles; one shuffle brings a bucket's
    rows together, and each bucket also gets the first rows of the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_op_id"),
                       F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    cuts = BUCKETS_EACH * shuffle_partitions(spark)
    bounds = rows.select("_op_id").agg(F.percentile_approx("_op_id", [i / cuts for i in range(1, cuts)], 10 * cuts)).first()[0] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b < F.col("_op_id")))
    rows = rows.withColumn("_op_bucket", bucket).withColumn("sketch", sketch(F.col("text"), k, n))
    firsts = sorted(tuple(r) for r in rows.select("_op_bucket", "_op_id").groupBy("_op_bucket").agg(F.min("_op_id")).collect())  # a row per bucket
    halo = [x for (b, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1], strict=True) for x in (F.lit(first), F.lit(b))]
    to = F.try_element_at(F.create_map(*halo), F.col("_op_id")) if halo else F.lit(None).cast("int")
    wraps = F.col("_op_id") == F.lit(firsts[0][1] if firsts else None)
    own = F.struct(F.col("_op_bucket").alias("b"), F.lit(0).alias("after"))
    copy = F.struct(to.alias("b"), F.when(wraps, 2).otherwise(1).alias("after"))
    placed = rows.withColumn("_op_to", F.explode(F.when(to.isNull(), F.array(own)).otherwise(F.array(own, copy))))
    order = Window.partitionBy("_op_to.b").orderBy("_op_to.after", "_op_id", "text")
    return (placed.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
            .where("_op_to.after = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """The input's columns and ``sketch`` (``sketch_`` if the input has one)."""
    return docs.withColumn(free_name(docs.columns, "sketch"), sketch(whole_text(), k, n))


def oracle() -> str:
    """DuckDB SQL of the query."""
    grams = ("CASE WHEN len({w}) >= 5 THEN list_transform(range(1, len({w}) - 3), lambda i: substr(md5({w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]"
             " || ' ' || {w}[i + 3] || ' ' || {w}[i + 4]), 1, 16)) WHEN len({w}) > 0 THEN [substr(md5(array_to_string({w}, ' ')), 1, 16)] ELSE [] END")
    like = ("CASE WHEN len({u}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({u}, list_intersect({a}, {b}))) AS DOUBLE) / len({u}) END")
    word = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    return rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id),
                  first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nt FROM documents),
e AS (SELECT *, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS et FROM o),
w AS (SELECT doc_id, t, et, {word.format('t')} AS w, {word.format('et')} AS ew FROM e),
s AS (SELECT doc_id, t, et, list_sort(list_distinct({grams.format(w='w')}))[1:{K}] AS a, list_sort(list_distinct({grams.format(w='ew')}))[1:{K}] AS ea FROM w),
p AS (SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id), first_value(a) OVER (ORDER BY doc_id)) AS na FROM s),
u AS (SELECT *, list_sort(list_distinct(list_concat(a, ea)))[1:{K}] AS ue, list_sort(list_distinct(list_concat(a, na)))[1:{K}] AS un FROM p)
SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, array_to_string(a, '') AS fingerprint,
       array_to_string(ea, '') AS edited_fingerprint, CAST({like.format(u='ue', a='a', b='ea')} AS DOUBLE) AS near_edited,
       CAST({like.format(u='un', a='a', b='na')} AS DOUBLE) AS near_next FROM u"""


@register("op3_fingerprints", oracle())
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(documents(spark, sf_dir)).withColumn("_op_edited", edited(F.col("text"), F.col("next_text")))
    drawn = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("_op_edited", 256).alias("edited_sha256"),
                         F.col("sketch").alias("_op_a"), sketch(F.col("_op_edited")).alias("_op_e"), F.col("next_sketch").alias("_op_n"))
    return drawn.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("_op_a", "").alias("fingerprint"), F.array_join("_op_e", "").alias("edited_fingerprint"),
        resemblance(F.col("_op_a"), F.col("_op_e")).alias("near_edited"), resemblance(F.col("_op_a"), F.col("_op_n")).alias("near_next"))
