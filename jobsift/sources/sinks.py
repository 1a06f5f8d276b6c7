"""Sinks: exports, batch files, snapshots, import and migration.

Writers go through Spark's output committer, so a retried or failed job
never leaves a half-written visible result.  Nothing is collected to the
driver except counts and listing metadata.
"""

from __future__ import annotations

import datetime as _dt
import re
import unicodedata

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning as CO
from ..operators import epochs as EP
from ..operators import merge as U
from ..operators import numbering as NU
from ..operators.search import JSON_COLUMNS
from . import files as FI
from . import readers as RD

JSON_OPTS = {"ignoreNullFields": "false"}


def write_json(df: DataFrame, path: str, array: bool = True, rows_per_file: int = 10_000,
               compression: str | None = None, mode: str = "errorifexists") -> str:
    """UTF-8 JSON (non-ASCII kept), null keys kept.

    ``array=False`` writes JSON lines.  ``array=True`` writes files that each hold
    one JSON array of at most ``rows_per_file`` records (the export format): each
    task cuts its own rows into arrays, so nothing is shuffled or counted and the
    number of tasks and files follows the input.
    """
    if not array:
        w = df.write.mode(mode).options(**JSON_OPTS)
        if compression:
            w = w.option("compression", compression)
        w.json(path)
        return path
    cols = [F.col(f"`{c}`") for c in df.columns]
    lines = df.select(F.to_json(F.struct(*cols), JSON_OPTS).alias("_j"))
    w = (lines.mapInPandas(_array_writer(rows_per_file), "value string")
         .write.mode(mode).option("maxRecordsPerFile", 1))
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    return path


def _array_writer(rows: int):
    """The per-partition function of the array export: documents of ``rows`` records each.

    Built as a closure so it is shipped to Python workers by value: workers
    need not have this package installed.
    """
    def bounded_arrays(batches):
        import pandas as pd

        held: list[str] = []
        for pdf in batches:
            held.extend(pdf["_j"])
            while len(held) >= rows:
                yield pd.DataFrame({"value": ["[" + ",".join(held[:rows]) + "]"]})
                del held[:rows]
        if held:
            yield pd.DataFrame({"value": ["[" + ",".join(held) + "]"]})

    return bounded_arrays


NULL_MARK = "\\N"


def write_csv(df: DataFrame, path: str, compression: str | None = None, null_value: str = NULL_MARK,
              mode: str = "errorifexists") -> str:
    """Header, no index; nested columns serialised to JSON text first.

    NULL is written as ``\\N`` so that it stays distinct from the empty string;
    blanks at either end of a value stay.
    """
    flat = CO.flatten_nested(df, null_literal=False)
    w = (flat.write.mode(mode).option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", null_value))
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  compression: str = "zstd", mode: str = "errorifexists") -> str:
    """K03 (+ K05 for parquet: compression inside the file)."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def sql_quote(c) -> F.Column:
    return F.concat(F.lit("'"), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("'"), F.lit("''")),
                    F.lit("'"))


def sql_insert_lines(df: DataFrame, table: str = "jobs", cols=("id", "title", "company")) -> DataFrame:
    """K04 lines: one ``INSERT INTO`` statement per row, quotes doubled."""
    vals = [sql_quote(c) for c in cols]
    stmt = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(cols)}) VALUES ("),
                    F.concat_ws(", ", *vals), F.lit(");"))
    return df.select(stmt.alias("value"))


def write_sql_inserts(df: DataFrame, path: str, table: str = "jobs", cols=("id", "title", "company"),
                      header: str = "-- jobs export", compression: str | None = None) -> str:
    """A comment header, then the statements (header first: partition 0)."""
    spark = df.sparkSession
    head = spark.createDataFrame([(header,)], "value string")
    w = head.union(sql_insert_lines(df, table, cols)).write.mode("errorifexists")
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    return path


def write_compressed(df: DataFrame, path: str, fmt: str) -> str:
    """Gzip for text formats, zstd inside parquet."""
    if fmt == "json":
        return write_json(df, path, array=False, compression="gzip")
    if fmt == "csv":
        return write_csv(df, path, compression="gzip")
    return write_parquet(df, path, compression="zstd")


def batch_name(batch_no: int, ts: _dt.datetime) -> str:
    return f"batch_{batch_no:04d}_{ts.strftime('%Y%m%d_%H%M%S')}"


def write_batch_triple(df: DataFrame, root: str, batch_no: int, ts: _dt.datetime, mode: str = "errorifexists") -> dict:
    """Raw JSON first; only if that succeeds, flattened parquet and CSV.  ``mode="overwrite"`` suits a batch that may be replayed.

    The batch is persisted (memory and disk) so the three writers read it once.
    """
    name = batch_name(batch_no, ts)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        paths = {"raw": write_json(cached, f"{root}/raw_data/{name}.json", array=False, mode=mode)}
        flat = CO.flatten_nested(cached, null_literal=False)
        paths["parquet"] = write_parquet(flat, f"{root}/processed_data/{name}.parquet", mode=mode)
        paths["csv"] = write_csv(flat, f"{root}/processed_data/{name}.csv", mode=mode)
    finally:
        cached.unpersist()
    return {"name": name, **paths}


def compact_columns(df: DataFrame) -> DataFrame:
    """The 9-column fallback record; missing text -> '', missing flag -> false."""
    def col_or(c, default, dtype="string"):
        return F.coalesce(F.col(c).cast(dtype), F.lit(default)) if c in df.columns else F.lit(default)

    return df.select(
        col_or("id", "").alias("id"), col_or("title", "").alias("title"),
        (F.coalesce(F.nullif(F.col("company_name_en"), F.lit("")), F.col("company_name_fa"), F.lit(""))
         if "company_name_en" in df.columns else col_or("company", "")).alias("company"),
        col_or("location", "").alias("location"),
        F.left(col_or("description", ""), F.lit(500)).alias("description"),
        col_or("url", "").alias("url"),
        col_or("activation_time", "").alias("posted_date"),
        col_or("job_type", "").alias("job_type"),
        col_or("remote", False, "boolean").alias("remote"))


def write_batch_compact(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> dict:
    """The fallback batch as ``processed_data/<name>.parquet`` and ``.csv``; returns the paths.

    The CSV is written from the Parquet files, so the batch is computed once.
    """
    path = write_parquet(compact_columns(df), f"{root}/processed_data/{name}.parquet", mode=mode)
    stored = RD.scan_parquet(df.sparkSession, path)
    return {"name": name, "parquet": path, "csv": write_csv(stored, f"{root}/processed_data/{name}.csv", mode=mode)}


def batch_manifest(spark: SparkSession, manifest_path: str, batch_no: int, name: str, ts: _dt.datetime,
                   row_count: int, paths: dict) -> DataFrame:
    """Append one manifest row per written batch; returns the row."""
    row = spark.createDataFrame(
        [(batch_no, name, ts, int(row_count), [v for k, v in sorted(paths.items()) if k != "name"])],
        "batch_no int, name string, created_at timestamp_ntz, row_count long, paths array<string>")
    row.write.mode("append").parquet(manifest_path)
    return row


def quarantine_sample(df: DataFrame, n: int = 5, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """A sample of ``n`` rows (description cut to 100 chars + '...') and a
    scalar-only dump of all rows (nested columns dropped)."""
    sample = df.orderBy(order).limit(n)
    if "description" in df.columns:
        d = F.col("description")
        sample = sample.withColumn("description", F.when(F.length(d) > 100, F.concat(F.left(d, F.lit(100)), F.lit("...")))
                                   .otherwise(d))
    scalars = [f.name for f in df.schema.fields
               if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]
    return sample, df.select(*scalars)


_SNAPSHOT_META = ("backup_date timestamp_ntz, backup_type string, db_included boolean, files_included boolean, "
                  "n_rows long, n_files long, file_bytes long")


def snapshot(df: DataFrame, root: str, ts: _dt.datetime, files_root: str | None = None) -> str:
    """Full dump, with ``files_root`` also a copy of every file below it and
    their manifest (name, size, sha256), and last one metadata row, so that a
    snapshot without metadata is one that did not finish.  Counts come from
    what was written."""
    spark = df.sparkSession
    path = f"{root}/snapshot={ts.strftime('%Y%m%d_%H%M%S')}"
    write_parquet(df, f"{path}/data")
    n_rows = spark.read.parquet(f"{path}/data").count()
    n_files = n_bytes = 0
    if files_root:
        copied = FI.copy_files(spark, files_root, f"{path}/files", f"{path}/manifest")
        n_files, n_bytes = copied.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    meta = spark.createDataFrame([(ts, "full" if files_root else "database_only", True, bool(files_root), n_rows, n_files,
                                   n_bytes)], _SNAPSHOT_META)
    meta.coalesce(1).write.mode("errorifexists").json(f"{path}/metadata")
    return path


def _snapshot_metadata(spark: SparkSession, path: str):
    row = spark.read.schema(_SNAPSHOT_META).json(f"{path}/metadata").first()
    if row is None:
        raise FileNotFoundError(f"snapshot {path} has no metadata")
    return row


def restore_snapshot(spark: SparkSession, path: str, table: str, now, key: str = "id") -> int:
    """Metadata required, then upsert every row into the table of epochs
    under ``table``; returns the new epoch."""
    _snapshot_metadata(spark, path)
    return EP.append(spark.read.parquet(f"{path}/data"), table, EP.next_epoch(spark, table), now, key)


def restore_snapshot_files(spark: SparkSession, path: str, to: str) -> DataFrame:
    """The files of a snapshot, verified against its manifest and its metadata, copied to ``to``."""
    meta = _snapshot_metadata(spark, path)
    if not meta["files_included"]:
        raise ValueError(f"snapshot {path} holds no files")
    manifest = spark.read.schema(FI.MANIFEST).parquet(f"{path}/manifest")
    recorded = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if tuple(recorded) != (meta["n_files"], meta["file_bytes"]):
        raise ValueError(f"the manifest of {path} is not the one its metadata counts")
    return FI.restore_files(spark, manifest, f"{path}/files", to)


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Per snapshot: name, path, size_bytes, size_mb, created_at, location
    (``local`` or the scheme of its path) and its metadata row (null where the
    snapshot did not finish); newest first.

    File sizes come from the ``binaryFile`` source with the content column
    pruned, so only listing metadata is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", "length", "modificationTime")
    snap = F.regexp_extract("path", r"(.*/snapshot=[^/]+)", 1)
    per = files.where(snap != "").groupBy(snap.alias("path")).agg(
        F.sum("length").alias("size_bytes"), F.min("modificationTime").alias("created_at"))
    name = F.regexp_extract("path", r"snapshot=([^/]+)", 1)
    scheme = F.regexp_extract("path", "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    fields = [f.split()[0] for f in _SNAPSHOT_META.split(", ")]
    meta = spark.read.schema(_SNAPSHOT_META).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.json").json(root).select(
        F.col("_metadata.file_path").alias("path"), F.struct(*fields).alias("metadata")).where(
        F.col("path").rlike(r"/snapshot=[^/]+/metadata/[^/]+$")).select(name.alias("name"), "metadata")
    return per.select(name.alias("name"), "path", "size_bytes", F.round(F.col("size_bytes") / 1048576, 2).alias("size_mb"),
                      "created_at", F.when(scheme.isin("", "file"), "local").otherwise(scheme).alias("location")).join(
        meta, "name", "left").orderBy(F.desc("created_at"), F.desc("name"))


def store_postings(df: DataFrame, path: str, compression: str = "zstd") -> str:
    """Write the postings table for readers: derived columns computed once in
    the write path (C10), partitioned by activation month and sorted by
    activation time inside each file, so date filters prune partitions and
    skip row groups by their min/max statistics (the layout that replaces the
    reference's indexes)."""
    from ..functions import derived as D
    # Range partitioning on (time, id) gives balanced tasks that each cover a
    # time range (a busy month spreads over many tasks; the id splits even a
    # single hot timestamp), and files come out sorted for min/max skipping.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (D.derive_all(df)
           .withColumn("activation_month", F.date_format("activation_time", "yyyy-MM"))
           .repartitionByRange(n, F.col("activation_time"), F.col("id"))
           .sortWithinPartitions("activation_time", "id"))
    out.write.mode("errorifexists").option("compression", compression).partitionBy("activation_month").parquet(path)
    return path


def list_exports(spark: SparkSession, root: str) -> DataFrame:
    """K12 (export listing): per export folder under ``root``: name, size in
    bytes, created (oldest file time) and format from the name's suffix;
    newest first.  Listing metadata only (``binaryFile`` without content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", "length", "modificationTime")
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").split(":", 1)[-1].replace(".", "\\.") + "/", "")
    name = F.regexp_extract(rel, "^([^/]+)", 1)
    per = files.where(~F.regexp_extract(rel, "([^/]+)$", 1).startswith("_")).groupBy(name.alias("name")).agg(
        F.sum("length").alias("size"), F.min("modificationTime").alias("created"))
    fmt = (F.when(F.col("name").rlike(r"\.json(\.gz|\.bz2)?$"), "json")
           .when(F.col("name").rlike(r"\.csv(\.gz|\.bz2)?$"), "csv")
           .when(F.col("name").rlike(r"\.parquet$"), "parquet")
           .when(F.col("name").rlike(r"\.sql$"), "sql").otherwise("unknown"))
    return per.select("name", "size", "created", fmt.alias("format")).orderBy(F.desc("created"), "name")


def export_name(ts: _dt.datetime, keyword: str | None = None, location: str | None = None, company: str | None = None,
                days: int | None = None) -> str:
    """The name of an export, without its suffix, from the active filters;
    what no file name should hold is left out."""
    active = {"keyword": keyword, "loc": location, "company": company, "days": days}
    name = "_".join(["jobs_export", *[f"{label}-{value}" for label, value in active.items() if value]])
    ascii_only = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^\w.-]", "", re.sub(r"[\s/\\]+", "_", ascii_only)).strip("._") + ts.strftime("_%Y%m%d_%H%M%S")


def export_search(hits: DataFrame, path: str, fmt: str = "csv") -> str:
    """The whole search result (no paging) as CSV or JSON.

    In JSON the five columns that hold JSON text become JSON values; text that
    does not parse stays text.
    """
    if fmt == "csv":
        return write_csv(hits, path)
    return write_json(hits.withColumns({c: F.coalesce(F.try_parse_json(c), F.col(c).cast("variant"))
                                        for c in JSON_COLUMNS if c in hits.columns}), path)


def import_postings(spark: SparkSession, path: str, table: str, now, fmt: str | None = None,
                    update_existing: bool = True, schema=None, files_root: str | None = None) -> DataFrame:
    """Scan -> validate -> upsert (or insert only) into the table of epochs
    under ``table``; returns total / inserted / updated / errors (and status
    ``empty`` for an empty input).  With ``files_root`` the accepted rows are
    also kept as JSON, parquet and CSV (K06).

    The upload is read once: it is persisted, and counted, validated and stored
    from there.  Of rows with one id the last in the upload is stored.
    """
    scanned = RD.scan_auto(spark, path, fmt=fmt, schema=schema)
    raw = scanned.withColumn("_arrival", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        has_id = F.col("id").isNotNull() & (F.col("id").cast("string") != "")
        stats = raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(~has_id).alias("errors")).first()
        valid = CO.validate_import(raw)
        held = EP.finished(spark, table)
        if held:
            counts = U.upsert_counts(EP.read(spark, table).select("id").distinct(), valid).first()
            inserted, updated = counts["inserted"], counts["updated"] if update_existing else 0
        else:
            inserted, updated = valid.select("id").distinct().count(), 0
        if stats["total"]:
            epoch = EP.next_epoch(spark, table)
            (EP.append if update_existing else EP.insert_new)(valid, table, epoch, now, order=["_arrival"], reread=True)
            if files_root:
                write_batch_triple(valid.drop("_arrival"), files_root, epoch, now if isinstance(now, _dt.datetime) else _dt.datetime.fromisoformat(now))
    finally:
        raw.unpersist()
    return spark.createDataFrame([("success" if stats["total"] else "empty", int(stats["total"]), int(inserted or 0),
                                   int(updated or 0), int(stats["errors"]))],
                                 "status string, total long, inserted long, updated long, errors long")


def migrate_postings(old: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Old -> new schema: ``source_id = coalesce(job_id, id)``; defaults
    ``''``, ``USD``, ``unknown``, ``{}``; ``still_active = true``.  ``keep`` are
    further columns of the old rows."""
    def c(name, default=None, dtype="string"):
        if name in old.columns:
            return F.coalesce(F.col(name).cast(dtype), F.lit(default)) if default is not None else F.col(name).cast(dtype)
        return F.lit(default).cast(dtype)

    src_id = F.coalesce(F.col("job_id").cast("string"), F.col("id").cast("string")) if "job_id" in old.columns \
        else F.col("id").cast("string")
    return old.select(
        *keep, src_id.alias("source_id"), c("title", "").alias("title"), c("company", "").alias("company"),
        c("location", "").alias("location"), c("description", "").alias("description"), c("url", "").alias("url"),
        c("salary_currency", "USD").alias("salary_currency"), c("job_type", "unknown").alias("job_type"),
        c("source_website", "unknown").alias("source_website"), c("metadata", "{}").alias("metadata"),
        F.lit(True).alias("still_active"))


def migrate_tables(jobs: DataFrame, tags: DataFrame, job_tags: DataFrame, root: str) -> dict[str, DataFrame]:
    """The old jobs, tags and job_tags as new tables, numbered under ``root``; see ``numbering.migrate_tables``."""
    def migrated(old: DataFrame) -> DataFrame:
        return migrate_postings(old, keep=(F.col("id").cast("string").alias("old_id"),))

    return NU.migrate_tables(jobs, tags, job_tags, root, migrated)
