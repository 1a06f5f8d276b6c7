"""Copies of files with checksums, made by the executors.

Spark lists, deals and records the files; a task streams each of its files in
blocks from one file system to the other and takes the SHA-256 on the way, so
memory does not grow with a file and no content passes the driver.  A copy is
written under a name of its own and renamed when it is whole: a lost executor
or a second attempt leaves no half file under a final name.

Paths are URIs that ``pyarrow.fs`` opens (local, s3, gs, hdfs); both folders
must be reachable from every executor.  One file is one task's work.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

BLOCK = 8 << 20
PART = ".part"
MANIFEST = "name string, size long, sha256 string"
OUTCOME = "name string, size long, sha256 string, status string"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` is Hadoop's way to write ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Names (relative to ``root``) and sizes of all files, hidden ones included.

    The driver lists the first level only; each folder found there is listed by
    a task.  An empty folder gives no row; a missing one is an error.
    """
    system, base = open_folder(root)
    top = [(info.path, info.type == fs.FileType.Directory, info.size)
           for info in system.get_file_info(fs.FileSelector(base))]
    entries = spark.createDataFrame([(p, d, s) for p, d, s in top], "path string, folder boolean, size long")

    def walk(batches):
        inner, start = open_folder(root)
        for batch in batches:
            for path, folder, size in zip(batch["path"], batch["folder"], batch["size"]):
                found = ([(i.path, i.size) for i in inner.get_file_info(fs.FileSelector(path, recursive=True))
                          if i.type == fs.FileType.File] if folder else [(path, int(size))])
                yield pd.DataFrame([(p[len(start) + 1:], s) for p, s in found if not p.endswith(PART)],
                                   columns=["name", "size"])

    n = max(1, min(len(top), spark.sparkContext.defaultParallelism * 4))
    return entries.repartition(n, "path").mapInPandas(walk, "name string, size long")


def _digest(stream, out=None) -> tuple[int, str]:
    size, sha = 0, hashlib.sha256()
    while block := stream.read(BLOCK):
        sha.update(block)
        size += len(block)
        if out is not None:
            out.write(block)
    return size, sha.hexdigest()


def _copy(source, src: str, target, dst: str, expected: str | None) -> tuple[int, str]:
    """Copies one file; where the checksum is not the expected one, nothing appears under ``dst``."""
    part = f"{dst}.{uuid.uuid4().hex}{PART}"
    target.create_dir(dst.rpartition("/")[0], recursive=True)
    with source.open_input_stream(src, compression=None) as r, target.open_output_stream(part, compression=None) as w:
        size, sha = _digest(r, w)
    if expected is None or sha == expected:
        target.move(part, dst)
    else:
        target.delete_file(part)
    return size, sha


def _dealt(files: DataFrame) -> DataFrame:
    """Files over all tasks, whatever folder holds most of them."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(n, F.xxhash64("name"))


def copy_files(spark: SparkSession, root: str, to: str, manifest: str) -> DataFrame:
    """Copies all files below ``root`` and writes the manifest (name, size, sha256), once, after the copies."""
    def run(batches):
        source, src = open_folder(root)
        target, dst = open_folder(to)
        for batch in batches:
            rows = [(name, *_copy(source, f"{src}/{name}", target, f"{dst}/{name}", None)) for name in batch["name"]]
            yield pd.DataFrame(rows, columns=["name", "size", "sha256"])

    _dealt(list_files(spark, root)).mapInPandas(run, MANIFEST).write.mode("errorifexists").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _checked(manifest: DataFrame, held: str, to: str | None) -> DataFrame:
    def run(batches):
        source, src = open_folder(held)
        target, dst = open_folder(to) if to else (None, None)
        for batch in batches:
            rows = []
            for name, size, sha in zip(batch["name"], batch["size"], batch["sha256"]):
                path = f"{src}/{name}"
                if source.get_file_info(path).type != fs.FileType.File:
                    rows.append((name, size, sha, "missing"))
                    continue
                if to:
                    got = _copy(source, path, target, f"{dst}/{name}", sha)
                else:
                    with source.open_input_stream(path, compression=None) as stream:
                        got = _digest(stream)
                rows.append((name, size, sha, "ok" if got == (size, sha) else "damaged"))
            yield pd.DataFrame(rows, columns=["name", "size", "sha256", "status"])

    return _dealt(manifest).mapInPandas(run, OUTCOME)


def verify_files(manifest: DataFrame, held: str) -> DataFrame:
    """Each file of the manifest with ``ok``, ``damaged`` or ``missing``; nothing is written."""
    return _checked(manifest, held, None)


def restore_files(spark: SparkSession, manifest: DataFrame, held: str, to: str) -> DataFrame:
    """Copies the manifest's files to ``to``; the checksum is taken again on the way.

    All files are verified before the first is copied.  A damaged or missing one
    refuses the restore (ValueError) and leaves ``to`` as it is.
    """
    bad = verify_files(manifest, held).where("status <> 'ok'")
    n, first = bad.agg(F.count(F.lit(1)), F.min(F.concat_ws(" ", "name", "status"))).first()
    if n:
        raise ValueError(f"{n} files of the snapshot are not as recorded, the first: {first}")
    log = work_path(spark, "restore", "outcome")
    _checked(manifest, held, to).write.mode("errorifexists").parquet(log)
    done = spark.read.schema(OUTCOME).parquet(log)
    if not done.where("status <> 'ok'").isEmpty():
        raise ValueError("files of the snapshot changed while they were restored")
    return done
