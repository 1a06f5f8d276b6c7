"""File and table sources.

Readers always take an explicit schema when one is known (no inference in
production paths), and never pull data through the driver: the only driver
work is choosing a reader from a path suffix or listing a folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters as FL
from ..operators import rows as RW
from ..operators import search as R

# --- fixed values: suffix -> format dispatch ------------------------------
SUFFIXES = {
    ".json": "json", ".json.gz": "json", ".json.bz2": "json",
    ".csv": "csv", ".csv.gz": "csv", ".csv.bz2": "csv",
    ".parquet": "parquet", ".gz": "json",
}
# --- end of fixed values --------------------------------------------------


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None, exact: bool = True) -> DataFrame:
    """UTF-8 files that each hold one JSON array of objects -> one row per object; a file that does not parse is a row of NULLs.

    A string column takes an object or a list as its text.  For that the
    multi-line reader goes back to the file once for each, and so reads a file
    many times over.  Where the text need not be the one in the file, blanks
    included, ``exact=False`` reads a file once and parses it in memory.
    """
    if exact or schema is None:
        r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
        if schema is not None:
            r = r.schema(schema)
        return r.json(path)
    row = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    objects = F.from_json("value", T.ArrayType(row), {"mode": "PERMISSIVE"})
    none = F.array().cast(T.ArrayType(row))
    files = spark.read.text(path, wholetext=True).select(
        F.when(F.col("value").rlike(r"^\s*$"), none).otherwise(F.coalesce(objects, F.array(F.lit(None).cast(row)))).alias("_objects"))
    return files.select(F.explode("_objects").alias("_o")).select(*[F.col(f"_o.`{f.name}`") for f in row.fields])


def scan_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             null_value: str | None = None, multiline: bool = False) -> DataFrame:
    """Header row, UTF-8; typed by the given schema (inference only if none).

    ``null_value`` names the NULL marker (our exports write ``\\N``).  Files whose
    quoted values hold line breaks need ``multiline``; a file is then one task.
    """
    r = (spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"')
         .option("multiLine", multiline))
    if null_value is not None:
        r = r.option("nullValue", null_value)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S03."""
    return spark.read.parquet(path)


def detect_format(path: str) -> str:
    """S04 dispatch: format from the extension; unknown suffix is an error."""
    p = path.rstrip("/").lower()
    if p.endswith(".parquet.gz"):
        raise ValueError("gzipped parquet is neither splittable nor readable; store parquet uncompressed outside")
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        if p.endswith(suffix):
            return SUFFIXES[suffix]
    raise ValueError(f"unsupported file type: {path}")


def scan_auto(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
              json_array: bool = True, null_value: str | None = None) -> DataFrame:
    """Read by explicit format or by suffix (S01-S03; compressed text by codec)."""
    fmt = fmt or detect_format(path)
    if fmt == "json":
        return scan_json_array(spark, path, schema) if json_array else scan_json_lines(spark, path, schema)
    if fmt == "csv":
        return scan_csv(spark, path, schema, null_value)
    if fmt == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported format {fmt}")


def scan_compressed(spark: SparkSession, path: str, fmt: str, schema=None, json_array: bool = False,
                    null_value: str | None = None) -> DataFrame:
    """Gzip / bzip2 text is decoded by Hadoop codecs from the file suffix
    (compressed exports are JSON lines or CSV); parquet compresses inside the file."""
    return scan_auto(spark, path, fmt=fmt, schema=schema, json_array=json_array, null_value=null_value)


def scan_filtered(df: DataFrame, activation_time_from=None, activation_time_to=None, company_id=None,
                  batch_id=None, limit: int = 0) -> DataFrame:
    """Optional inclusive date range, company and batch (AND-ed), limit 0 = all.

    On a table partitioned by ``batch_id`` the batch filter prunes partitions;
    the date range and company are pushed to the parquet reader.
    """
    preds = [FL.between_dates(activation_time_from, activation_time_to)]
    if company_id not in (None, ""):
        preds.append(F.col("company_id") == F.lit(str(company_id)))
    if batch_id not in (None, ""):
        preds.append(F.col("batch_id") == F.lit(str(batch_id)))
    return R.limit_rows(df.where(FL.all_of(preds)), limit)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def scan_with_fallback(spark: SparkSession, root: str, key: str = "id", order=("page", "position"),
                       schema=None) -> DataFrame:
    """``raw_data/*.json``, else ``processed_data/*.parquet``, else ``*.csv``;
    then last-wins de-dup by key, rows without a key dropped.  Unreadable and
    malformed files are skipped."""
    candidates = [("json", f"{root}/raw_data/*.json"), ("parquet", f"{root}/processed_data/*.parquet"),
                  ("csv", f"{root}/*.csv")]
    for fmt, pattern in candidates:
        if _exists(spark, pattern):
            r = spark.read.option("ignoreCorruptFiles", True)
            if fmt == "json":
                r = r.option("multiLine", True).option("mode", "DROPMALFORMED")
                df = (r.schema(schema) if schema is not None else r).json(pattern)
            elif fmt == "parquet":
                df = r.parquet(pattern)
            else:
                r = r.option("header", True).option("mode", "DROPMALFORMED")
                df = (r.schema(schema) if schema is not None else r).csv(pattern)
            return RW.dedupe_last(df, key, order)
    raise FileNotFoundError(f"no json, parquet or csv data under {root}")


def read_legacy_table(spark: SparkSession, name: str, jdbc_url: str | None = None,
                      properties: dict | None = None) -> DataFrame:
    """Full-table read for a migration: JDBC when a URL is given, else a
    catalog table / view."""
    if jdbc_url:
        return spark.read.jdbc(jdbc_url, name, properties=properties or {})
    return spark.table(name)


def count_import_records(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Records in an upload: JSON array length, CSV lines minus header,
    or occurrences of ``INSERT INTO`` in SQL text (counted per line, summed).
    One pass: a schema of one column is given, none is inferred."""
    if fmt == "json":
        return scan_json_array(spark, path, "id string").agg(F.count(F.lit(1)).alias("records"))
    if fmt == "csv":
        return scan_csv(spark, path, "id string").agg(F.count(F.lit(1)).alias("records"))
    if fmt == "sql":
        txt = spark.read.text(path)
        return txt.agg(F.coalesce(F.sum(F.regexp_count("value", F.lit("INSERT INTO"))), F.lit(0))
                       .cast("long").alias("records"))
    raise ValueError(fmt)


def scan_schema_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of a schema (catalog metadata, not data)."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
