"""Exact dedup (11): content-defined chunk recipes, compared as ordered lists of verified chunk identifiers.

A text is cut into units after a line feed or a sentence mark; a chunk ends
after a unit whose hash is a multiple of ``CUT_EVERY`` (so where it ends follows
from the content near it, not from its place), and a chunk of more than
``MAX_CHARS`` code points is cut on into pieces of that many.  A chunk's
identifier is its 64-bit hash and its number among the different chunks of that
hash: chunks meet once, by whole content, and only where two of them share a
hash (``collided``) does the number differ from 0.  Texts are equal when their
recipes, the ordered lists of identifiers, are equal.  So each distinct chunk
crosses the network once, and of the documents only their recipes move on.

Defined results: a null text counts as empty, all empty texts are equal; of
equal texts the row with the largest doc_id stays (a null doc_id is less than
any other), and of rows that share doc_id and text one stays, all being
counted; an empty table gives no rows; extra columns stay as they are, the
verdict comes as one struct column ``copies`` (``copies_`` if the input has one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import documents, free_name, let, stored, whole_text

#: A unit ends after a line feed or a sentence mark.
UNIT_END = r"(?<=[\n.!?])"
CUT_EVERY = 8
MAX_CHARS = 4096


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(text: Column, every: int = CUT_EVERY, max_chars: int = MAX_CHARS) -> Column:
    """The content-defined chunks of a non-null text, in order; joined they are the text."""

    def ends(units: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(units)),
                        lambda i: (i == F.size(units)) | (F.pmod(F.xxhash64(F.get(units, i - 1)), F.lit(every)) == 0))

    def joined(units: Column) -> Column:
        def part(e: Column) -> Column:
            def one(end: Column, j: Column) -> Column:
                start = F.coalesce(F.get(e, j - 1), F.lit(0))
                return F.array_join(F.slice(units, start + 1, end - start), "")

            return F.transform(e, one)

        return let(ends(units), part)

    pieces = F.lit(f"(?s).{{1,{max_chars}}}")
    return F.flatten(F.transform(let(F.split(text, UNIT_END), joined), lambda c: F.when(
        F.char_length(c) > max_chars, F.regexp_extract_all(c, pieces, F.lit(0))).otherwise(F.array(c))))


def collided(docs: DataFrame, text: Column, hashed=chunk_hash, **cut) -> DataFrame:
    """The hashes that two or more different chunks share (as a rule none): chunks are compared by their whole content."""
    parts = docs.select(F.explode(chunks(text, **cut)).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk")
    return parts.distinct().groupBy("h").count().where("count > 1").select("h")


def recipes(docs: DataFrame, text_col: str = "text", hashed=chunk_hash, **cut) -> DataFrame:
    """The input without its text, ``_op_row`` (a number of its own), ``_op_sha`` and ``_op_recipe``, written and reread."""
    spark, text = docs.sparkSession, whole_text(F.col(f"`{text_col}`"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    base = docs.select(*rest, F.monotonically_increasing_id().alias("_op_row"), F.sha2(text, 256).alias("_op_sha"),
                       F.transform(chunks(text, **cut), lambda c: F.struct(hashed(c).alias("h"), F.lit(0).alias("k"))).alias("_op_recipe"))
    base = stored(spark, base, "recipes")
    shared = stored(spark, collided(docs, text, hashed, **cut), "collided")
    if shared.isEmpty():
        return base
    # number the chunks of one hash by content, and correct the recipes of the texts that hold one with a number over 0
    parts = docs.select(F.sha2(text, 256).alias("_op_sha"), F.posexplode(chunks(text, **cut)).alias("pos", "chunk"))
    parts = parts.withColumn("h", hashed(F.col("chunk"))).join(shared, "h", "left_semi")
    among = Window.partitionBy("h").orderBy("chunk")
    numbers = parts.select("h", "chunk").distinct().withColumn("k", F.row_number().over(among) - 1).where("k > 0")
    fixes = (parts.join(numbers, ["h", "chunk"]).groupBy("_op_sha", "pos").agg(F.min("k").alias("k"))
             .groupBy("_op_sha").agg(F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("_op_fix")))

    def mended(piece: Column, pos: Column) -> Column:
        return F.struct(piece["h"].alias("h"), F.coalesce(F.try_element_at(F.col("_op_fix"), pos), piece["k"]).alias("k"))

    return stored(spark, base.join(fixes, "_op_sha", "left").withColumn(
        "_op_recipe", F.when(F.col("_op_fix").isNull(), F.col("_op_recipe")).otherwise(F.transform("_op_recipe", mended)))
        .select(*base.columns), "recipes-numbered")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's columns without the text, and the struct ``copies``: keep_id, group_size, kept, text_sha256, n_chunks."""
    found = recipes(docs, text_col, **how)
    row = F.struct(F.col(f"`{id_col}`").alias("id"), F.col("_op_row").alias("row"))
    groups = (found.groupBy("_op_recipe").agg(F.max(row).alias("_op_keep"), F.count(F.lit(1)).alias("_op_n"))
              .where("_op_n > 1").withColumnRenamed("_op_recipe", "_op_group"))
    joined = found.join(groups, F.col("_op_recipe") == F.col("_op_group"), "left")
    alone = F.col("_op_n").isNull()
    verdict = F.struct(
        F.when(alone, F.col(f"`{id_col}`")).otherwise(F.col("_op_keep.id")).alias("keep_id"),
        F.coalesce("_op_n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_op_keep.row") == F.col("_op_row"))).alias("kept"),
        F.col("_op_sha").alias("text_sha256"), F.size("_op_recipe").alias("n_chunks"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], verdict.alias(free_name(docs.columns, "copies")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of the input that stay, whole."""
    thin = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kept = exact_copies(thin, "id", "text", **how).where("copies.kept").select(
        F.col("id").alias("_op_id"), F.col("copies.text_sha256").alias("_op_sha"))
    keyed = docs.withColumn("_op_text_sha", F.sha2(whole_text(F.col(f"`{text_col}`")), 256))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col("_op_id")) & (F.col("_op_text_sha") == F.col("_op_sha"))
    # rows that repeat doc_id and text: one of them
    again = keyed.groupBy(F.col(f"`{id_col}`").alias("_op_id"), F.col("_op_text_sha").alias("_op_sha")).count().where("count > 1").drop("count")
    single = keyed.join(kept, on, "left_semi").join(again, on, "left_anti").drop("_op_text_sha")
    packed = keyed.join(again.join(kept, ["_op_sha"], "left_semi"), on, "left_semi")
    repeated = packed.groupBy(F.col(f"`{id_col}`").alias("_op_id"), "_op_text_sha").agg(
        F.any_value(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_op_all")).select("_op_all.*")
    return single.unionByName(repeated)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@register("op11_exact_dedup", ORACLE)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "copies.keep_id", "copies.group_size", "copies.kept", "copies.text_sha256")
