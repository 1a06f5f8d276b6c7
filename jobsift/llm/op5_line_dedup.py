"""Line dedup (5): range-partitioned line hashes, streamed in order of document and position.

A line's key is the line without white space at its ends, A-Z lower-cased;
128 bits of hash stand for it.  The hashes are range-partitioned, with the
rows of one hash dealt over ``CHUNKS`` chunks of documents so that a very
common line is no single group; inside, a secondary sort by document and
position lets one pass mark first occurrences and count documents.  Keys in at
least ``min_docs`` documents lose their lines: all of them, or all but the
first of the corpus.  The result is a compressed keep bitmap per document, as
the runs of lines it drops; texts are not shuffled for it.

Defined results: a null or empty text is one empty line; an empty key is never
dropped; rows that share doc_id and text are one document, rows that share
only doc_id count as one document of a line; an empty table gives no rows;
extra columns are ignored, and kept by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import documents, let, lower_ascii, on_key, shuffle_partitions, strip_ws, text_key, whole_text

MIN_DOCS = 10
MIN_CHARS = 1
#: Groups that the documents of one line are dealt over.
CHUNKS = 64


def line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: lower_ascii(strip_ws(x)))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per line with a key of at least min_chars: row key, pos, h1, h2, chunk."""
    text = whole_text()
    rows = docs.select(*text_key(F.col("doc_id"), text), F.posexplode(line_keys(F.split(text, "\n"))).alias("_op_pos", "_op_line"))
    return rows.where(F.char_length("_op_line") >= min_chars).select(
        "_op_id", "_op_h1", "_op_h2", "_op_pos", F.xxhash64("_op_line").alias("l1"), F.xxhash64(F.lit("second"), "_op_line").alias("l2"),
        F.pmod(F.xxhash64("_op_id"), F.lit(CHUNKS)).alias("chunk"))


def dropped_runs(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """Keep bitmaps: the row key and ``runs``, the runs of lines (from, length) that the document drops.

    Documents that drop no line have no row.
    """
    rows = occurrences(docs, min_chars)
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "l1", "l2", "chunk")
    stream = Window.partitionBy("l1", "l2", "chunk").orderBy("_op_id", "_op_pos", "_op_h1", "_op_h2")
    marked = dealt.withColumns({
        "first": F.row_number().over(stream) == 1,
        "new_doc": (F.row_number().over(stream) == 1) | ~F.lag("_op_id").over(stream).eqNullSafe(F.col("_op_id")),
    })
    place = F.struct(F.col("_op_id"), F.col("_op_pos"), F.col("_op_h1"), F.col("_op_h2"))
    chunks = marked.groupBy("l1", "l2", "chunk").agg(F.sum(F.col("new_doc").cast("long")).alias("docs"), F.min(F.when(F.col("first"), place)).alias("at"))
    common = (chunks.groupBy("l1", "l2").agg(F.sum("docs").alias("docs"), F.min("at").alias("at"), F.collect_set("chunk").alias("chunks"))
              .where(F.col("docs") >= min_docs).select("l1", "l2", "at", F.explode("chunks").alias("chunk")))
    drop = rows.join(common, ["l1", "l2", "chunk"])
    if keep_first:
        drop = drop.where(~place.eqNullSafe(F.col("at")))
    return drop.groupBy("_op_id", "_op_h1", "_op_h2").agg(F.array_sort(F.collect_set("_op_pos")).alias("places")).select(
        "_op_id", "_op_h1", "_op_h2", runs(F.col("places")).alias("runs"))


def runs(places: Column) -> Column:
    """Ascending places as an array of (from, length)."""

    def of(p: Column) -> Column:
        first = F.filter(p, lambda x, j: ~(F.get(p, j - 1)).eqNullSafe(x - 1))
        last = F.filter(p, lambda x, j: ~(F.get(p, j + 1)).eqNullSafe(x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("from"), (b - a + 1).alias("length")))

    return let(places, of)


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs."""

    def between(d: Column) -> Column:
        def part(j: Column) -> Column:
            start = F.coalesce(F.get(d, j - 1)["from"] + F.get(d, j - 1)["length"], F.lit(0))
            return F.slice(lines, start + 1, F.coalesce(F.get(d, j)["from"], F.size(lines)) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), part))

    return F.when(dropped.isNull(), lines).otherwise(let(dropped, between))


def with_kept(docs: DataFrame, **rule) -> DataFrame:
    """The input's columns, ``_op_lines``, ``_op_runs`` (null: none) and ``_op_kept``, the lines that stay."""
    text = whole_text()
    keyed = docs.select("*", *text_key(F.col("doc_id"), text), F.split(text, "\n").alias("_op_lines"))
    joined = keyed.alias("d").join(dropped_runs(docs, **rule).alias("b"), on_key("d", "b"), "left")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*columns, "_op_lines", F.col("b.runs").alias("_op_runs")).withColumn(
        "_op_kept", kept_lines(F.col("_op_lines"), F.col("_op_runs")))


def drop_lines(docs: DataFrame, **rule) -> DataFrame:
    """The input with repeated lines gone from ``text``; n_chars, if there, follows.  Untouched texts stay as they are."""
    kept = with_kept(docs, **rule)
    changed = F.col("_op_runs").isNotNull()
    text = F.when(changed, F.array_join("_op_kept", "\n")).otherwise(F.col("text"))
    out = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@register("op5_line_dedup", ORACLE)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = with_kept(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.size("_op_lines").cast("long").alias("n_lines"),
                       (F.size("_op_lines") - F.size("_op_kept")).cast("long").alias("n_dropped"),
                       F.sha2(F.array_join("_op_kept", "\n"), 256).alias("kept_sha256"))
