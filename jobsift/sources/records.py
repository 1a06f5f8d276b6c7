"""CSV and JSON-array files of any size read by many tasks (S01, S02): records glued from lines.

The built-in ``multiLine`` readers take one task a file.  Here a file's lines
are read split by split, each with its file, the start of its split and its
order there.  A line changes a count (the quotes of a CSV line; the brackets of
a JSON line outside its strings, which cannot hold a line break).  The count
before a line, summed over its split and the splits before it, tells whether a
record begins there.  Most records are one line and go straight on: a split
without longer ones is read by its task and shuffled nowhere.  Only lines of
longer records meet, by record.  What is small, and broadcast, is a row per split.

CSV follows RFC 4180: a quote inside a quoted value is doubled, and one stands
in no value that is not quoted.  A lost executor reads its splits again, with
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Possessive, so that the matcher loops over a long string instead of nesting a call for each sign.
_STRINGS = r'"(?:[^"\\]++|\\.)*+"'


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (cut at line feeds alone): value, _file, _split, _line (ascending inside a split)."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"))


def glued_records(lines: DataFrame, change: Column, begins, ends) -> DataFrame:
    """Records: _file, _split and _line of their first line, ``text``, ``before`` and ``after`` (the counts around it), ``first`` (of its file).

    ``change`` is what a line adds to the count; a record begins at a line with
    ``begins(count before)``, and a line that begins one ends it with ``ends(count after)``;
    a record begins after a line where one can end.
    """
    lines = lines.withColumn("_change", change.cast("long"))
    by_file = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("_file", "_split").agg(F.sum("_change").alias("_sum"), F.min("_line").alias("_top"), F.max(F.col("_change") != 0).alias("_mixed"))
    offsets = sums.select("_file", "_split", "_top", "_mixed", F.coalesce(F.sum("_sum").over(by_file), F.lit(0)).alias("_offset"))
    # a row per split: lines stay where they are read, but for those of splits in which records span lines
    calm = ~F.col("_mixed") & begins(F.col("_offset")) & ends(F.col("_offset"))
    first = ((F.col("_split") == 0) & (F.col("_line") == F.col("_top"))).alias("first")
    plain = lines.join(F.broadcast(offsets.where(calm)), ["_file", "_split"]).select(
        "_file", "_split", "_line", "value", F.col("_offset").alias("before"), F.col("_offset").alias("after"), first)
    lines = lines.join(F.broadcast(offsets.where(~calm)), ["_file", "_split"])
    split = Window.partitionBy("_file", "_split").orderBy("_line")
    local = F.coalesce(F.sum("_change").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = lines.select("*", local.alias("_local"), first).withColumn("before", F.col("_offset") + F.col("_local")).withColumn(
        "after", F.col("before") + F.col("_change"))
    place = F.struct(F.col("_split").alias("s"), F.col("_line").alias("l"))
    started = counted.withColumn("_start", F.when(begins(F.col("before")), place))
    single = F.col("_start").isNotNull() & ends(F.col("after"))
    columns = ["_file", "_split", "_line", "value", "before", "after", "first"]
    alone = started.where(single).select(*columns)
    # the other lines go to the last record that began at or before them, in their split or an earlier one
    mine = started.withColumn("_own", F.last("_start", ignorenulls=True).over(split.rowsBetween(Window.unboundedPreceding, 0)))
    last_of = started.groupBy("_file", "_split").agg(F.max("_start").alias("_last"))
    carried = last_of.select("_file", "_split", F.max("_last").over(by_file).alias("_carried"))
    parts = mine.where(~single).join(carried, ["_file", "_split"], "left").withColumn("_own", F.coalesce("_own", "_carried"))
    whole = parts.groupBy("_file", "_own").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_split", "_line", "value"))).getField("value"), "\n").alias("value"),
        F.min_by("before", place).alias("before"), F.max_by("after", place).alias("after"), F.max("first").alias("first"))
    glued = whole.select("_file", F.col("_own.s").alias("_split"), F.col("_own.l").alias("_line"), "value", "before", "after", "first")
    return plain.unionByName(alone).unionByName(glued).withColumnRenamed("value", "text")


def scan_csv_records(spark: SparkSession, path: str, schema: str, null_value: str | None = None, header: bool = True) -> DataFrame:
    """Rows of CSV files whose quoted values may hold line breaks, by as many tasks as splits.

    As ``scan_csv(multiline=True)`` with a schema: values by position, the first
    record of each file left out as its header, empty lines skipped.
    """
    options = csv_options(null_value)
    return csv_texts(spark, path, header).select(F.from_csv("text", schema, options).alias("_row")).select("_row.*")


def csv_options(null_value: str | None = None) -> dict:
    return {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"} | ({"nullValue": null_value} if null_value is not None else {})


def csv_texts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Records of CSV files as text, with the place of each: the header and empty lines left out."""
    text = F.col("value")
    quotes = (F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit("")))) % 2
    found = glued_records(numbered_lines(spark, path), quotes, lambda n: n % 2 == 0, lambda n: n % 2 == 0)
    record = F.regexp_replace("text", r"\r$", "")
    return found.where(~F.col("first") if header else F.lit(True)).where(F.trim(record) != "").withColumn("text", record)


def scan_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that each hold one JSON array, pretty-printed or with objects on lines of their own, by as many tasks as splits.

    A line may hold several objects, an object several lines; an array on one line is one task.
    """
    rows = json_texts(spark, path).where("text <> ''")
    return rows.select(F.explode(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), f"array<struct<{_fields(schema)}>>")).alias("_row")).select("_row.*")


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Objects of JSON arrays or JSON lines as text (several with commas between them; empty at a bracket alone), with their place and the depths around them."""
    bare = F.regexp_replace("value", _STRINGS, "")
    depth = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))
    found = glued_records(numbered_lines(spark, path), depth, lambda n: n <= 1, lambda n: n <= 1)
    text = F.trim(F.regexp_replace("text", r"\s+$", ""))
    text = F.when(F.col("before") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    text = F.when((F.col("after") == 0), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return found.withColumn("text", F.regexp_replace(F.regexp_replace(text, r"^[\s,]+", ""), r"[\s,]+$", ""))


def _fields(schema: str) -> str:
    """``a long, b string`` as the fields of a struct type."""
    from pyspark.sql import types as T

    return T.StructType.fromDDL(schema).simpleString()[len("struct<"):-1]
