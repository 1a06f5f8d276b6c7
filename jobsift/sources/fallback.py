"""S07 with nothing lost unseen: the first source that holds records, what was kept of it, what was set apart, and counts a file.

Text sources are parsed once, by as many tasks as splits (``records``), into a
landing table; the rows, the records set apart and the report are read from
it.  A record that does not parse is kept as text with its file.  The report
has a row per file that holds a byte, also for files that gave no record.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rows as RW
from ..session import work_path
from . import readers as RD
from . import records as RC

#: Where a record stands: columns of these names are the reader's own.
PLACE = ("_file", "_split", "_line", "_at")


class Fallback(NamedTuple):
    """``rows``: last of each key; ``set_apart``: _file, reason, record; ``report``: counts a file."""

    source: str
    rows: DataFrame
    set_apart: DataFrame
    report: DataFrame


def _ddl(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def json_candidates(spark: SparkSession, path: str, schema, lines: bool = False) -> DataFrame:
    """Records of JSON arrays: place, ``_row`` (null where it does not parse), ``_record`` (its text then), ``_depth`` after it.

    Brackets that stand alone have neither; they carry the depth at the end of a
    file.  With ``lines`` each line is a record, and a torn one costs no other;
    without it whole JSON lines are read as well, but brackets that a line
    leaves open reach to the end of its file.
    """
    if lines:
        line = F.regexp_replace("value", r"\r$", "")
        found = RC.numbered_lines(spark, path).select("_file", "_split", "_line", F.lit(0).cast("long").alias("after"),
                                                      F.when(F.trim(line) == "", "").otherwise(line).alias("text"))
    else:
        found = RC.json_texts(spark, path)
    objects = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), T.ArrayType(_ddl(schema)))
    return found.select("_file", "_split", "_line", F.col("after").alias("_depth"), "text",
                        F.posexplode_outer(F.when(F.col("text") != "", objects)).alias("_at", "_row")).select(
        *PLACE, "_depth", "_row", F.when(F.col("_row").isNull(), F.nullif("text", F.lit(""))).alias("_record"))


def csv_candidates(spark: SparkSession, path: str, schema, null_value: str | None = None) -> DataFrame:
    """Records of CSV files, as ``json_candidates``: one with too few or too many values, or with one of another type, does not parse."""
    fields = _ddl(schema)
    wide = T.StructType([*fields.fields, T.StructField("_unread", T.StringType())])
    options = RC.csv_options(null_value) | {"columnNameOfCorruptRecord": "_unread"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.fields)
    parsed = RC.csv_texts(spark, path).withColumn("_wide", F.from_csv("text", ddl, options))
    good = F.col("_wide._unread").isNull()
    row = F.struct(*[F.col(f"_wide.`{f.name}`").alias(f.name) for f in fields.fields])
    return parsed.select("_file", "_split", "_line", F.lit(0).alias("_at"), F.lit(0).cast("long").alias("_depth"),
                         F.when(good, row).alias("_row"), F.when(~good, F.col("text")).alias("_record"))


def parquet_candidates(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of Parquet files; an unreadable file gives none and stands so in the report."""
    df = spark.read.schema(_ddl(schema)).option("ignoreCorruptFiles", True).parquet(path)
    return df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                     F.monotonically_increasing_id().alias("_line"), F.lit(0).alias("_at"), F.lit(0).cast("long").alias("_depth"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.lit(None).cast("string").alias("_record"))


def scan_fallback(spark: SparkSession, root: str, schema, key: str = "id", order=("page", "position"),
                  whole_files: bool = True, null_value: str | None = None, json_lines: bool = False) -> Fallback:
    """``raw_data/*.json``, else ``processed_data/*.parquet``, else ``processed_data/*.csv`` or ``*.csv``.

    A source whose files hold no usable record is passed over.  ``whole_files``
    leaves out all of a text file that holds a record that does not parse or
    that ends inside one (a torn file); otherwise its other records are used.
    The last row of a key wins by ``order``, then by file and place; rows
    without the key are counted and left out.
    """
    sources = [("json", f"{root}/raw_data/*.json"), ("parquet", f"{root}/processed_data/*.parquet"),
               ("csv", f"{root}/processed_data/*.csv"), ("csv", f"{root}/*.csv")]
    for fmt, path in sources:
        if not RD._exists(spark, path):
            continue
        if fmt == "parquet":
            landed = parquet_candidates(spark, path, schema)
        else:
            found = json_candidates(spark, path, schema, json_lines) if fmt == "json" else csv_candidates(spark, path, schema, null_value)
            table = work_path(spark, "landing", "records")
            found.write.parquet(table)
            landed = spark.read.parquet(table)
        result = _judge(spark, path, landed, key, order, whole_files and fmt != "parquet")
        if not result.rows.isEmpty():
            return result
    raise FileNotFoundError(f"no json, parquet or csv records under {root}")


def _judge(spark: SparkSession, path: str, landed: DataFrame, key: str, order, whole_files: bool) -> Fallback:
    place = F.struct("_split", "_line", "_at")
    bad, good = F.col("_record").isNotNull(), F.col("_row").isNotNull()
    no_key = good & F.col(f"_row.`{key}`").isNull()
    per_file = landed.groupBy("_file").agg(
        F.count_if(bad | good).alias("records"), F.count_if(bad).alias("malformed"), F.count_if(no_key).alias("no_key"),
        (F.max_by("_depth", place) != 0).alias("unclosed"))
    torn = per_file.where("malformed > 0 OR unclosed").select("_file")
    usable = landed.where(good)
    if whole_files:
        usable = usable.join(torn, "_file", "left_anti")
    kept = RW.dedupe_last(usable.select("_row.*", *PLACE), key, [*order, *PLACE])

    apart = [landed.where(bad).select("_file", F.lit("malformed").alias("reason"), F.col("_record").alias("record")),
             landed.where(no_key).select("_file", F.lit("no_key").alias("reason"), F.to_json("_row").alias("record"))]
    if whole_files:
        apart.append(landed.where(good & ~no_key).join(torn, "_file", "left_semi")
                     .select("_file", F.lit("torn_file").alias("reason"), F.to_json("_row").alias("record")))

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), F.col("length").alias("bytes"))
    kept_of = kept.groupBy("_file").agg(F.count(F.lit(1)).alias("kept"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("records", "malformed", "no_key", "kept")}
    counts = files.join(per_file, "_file", "left").join(kept_of, "_file", "left").withColumns(zero)
    left_out = F.lit(whole_files) & ((F.col("malformed") > 0) | F.col("unclosed"))
    others = F.col("records") - F.col("malformed") - F.col("no_key") - F.col("kept")
    report = counts.select(
        "_file", "bytes", "records", "malformed", "no_key", F.when(left_out, others).otherwise(0).alias("torn"),
        F.when(left_out, 0).otherwise(others).alias("superseded"), "kept",
        F.when(F.col("records") == 0, "no records").when(left_out, "torn").otherwise("read").alias("state"))
    set_apart = apart[0]
    for more in apart[1:]:
        set_apart = set_apart.unionByName(more)
    return Fallback(path, kept.drop(*PLACE), set_apart, report)
