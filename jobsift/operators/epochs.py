"""A postings table kept as append-only epochs of plain Parquet.

Each batch is one folder ``<root>/epoch=<n>`` of whole rows, one row per key,
written by Spark's own Parquet writer.  The table is a view: the row of the
newest epoch that holds a key.  A batch therefore costs what the batch holds,
not what the table holds, and nothing is read back to write it.

A folder counts once its writer has left ``_SUCCESS``; what a dead job left is
not read, and writing the epoch again replaces it.  A replayed epoch is thus the
same epoch, not a second one.  ``rewrite`` folds all epochs into one, in a fresh
folder, from time to time: readers of the old folder are not disturbed, and a
table of one epoch is read by a plain scan.

One root has one numbering: a stream's epochs (from its checkpoint, see
``stream_ingest``) or ``next_epoch`` for batch jobs run one after another.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_removed
from .merge import audit_feed, dedupe_batch, dedupe_reread, delete_by_id, keep_keys, keys_not_in, with_audit_columns

STAMPS = ("created_at", "updated_at")


def _folder(root: str, epoch: int) -> str:
    return f"{root.rstrip('/')}/epoch={int(epoch)}"


def finished(spark: SparkSession, root: str, after: int | None = None, upto: int | None = None) -> list[int]:
    """Numbers of the whole epochs in ``(after, upto]``: one name per batch since the last rewrite."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/epoch=*/_SUCCESS")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    found = sorted(int(f.getPath().getParent().getName().split("=", 1)[1]) for f in files)
    return [e for e in found if (after is None or e > after) and (upto is None or e <= upto)]


def next_epoch(spark: SparkSession, root: str) -> int:
    return max(finished(spark, root), default=0) + 1


def read(spark: SparkSession, root: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Every stored row with its ``epoch``, under the columns of the newest epoch read."""
    found = finished(spark, root, after, upto)
    if not found:
        raise FileNotFoundError(f"no finished epoch under {root}")
    schema = spark.read.parquet(_folder(root, found[-1])).schema
    return (spark.read.schema(schema.add("epoch", "long")).option("basePath", root)
            .parquet(*[_folder(root, e) for e in found]))


def append(rows: DataFrame, root: str, epoch: int, now=None, key: str = "id", order: list[str] | None = None,
           counted: Observation | None = None, reread: bool = False) -> int:
    """Store a batch as an epoch; a matched key keeps its ``created_at``.

    ``order`` tells the last arrival among rows of one key; those of its columns
    whose names start with ``_`` are not stored.  A batch carries
    every column of the table (new ones may join); a lacking one is an error,
    since it could not be told from one set to NULL.  ``now`` is by default the
    time of writing: a replay replaces the epoch, so it need not repeat it.
    ``counted`` observes the rows as they are written (``n``).  ``reread`` tells
    that the rows are persisted or cheap to read again: see ``dedupe_reread``.
    """
    spark = rows.sparkSession
    earlier = finished(spark, root, upto=epoch - 1)
    given = rows.drop(*STAMPS)
    if earlier:
        held = spark.read.parquet(_folder(root, earlier[-1])).columns
        lacking = sorted(set(held) - set(given.columns) - set(STAMPS))
        if lacking:
            raise ValueError(f"an epoch carries every column of the table; the batch lacks {lacking}")
    now = F.current_timestamp() if now is None else now
    unique = (dedupe_reread if reread else dedupe_batch)(given, key, order).drop(*[c for c in order or () if c.startswith("_")])
    stored = with_audit_columns(unique, now)
    if counted is not None:
        stored = stored.observe(counted, F.count(F.lit(1)).alias("n"))
    stored.write.mode("overwrite").option("compression", "zstd").parquet(_folder(root, epoch))
    return epoch


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """Per key the row of its newest epoch, ``created_at`` of its first: a two-phase aggregate on the key."""
    columns = [c for c in rows.columns if c != "epoch"]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns if c not in (key, "created_at")])
    newest = rows.groupBy(key).agg(F.max_by(whole, "epoch").alias("_r"), F.min_by("created_at", "epoch").alias("created_at"))
    return newest.select(*[F.col(f"`{c}`") if c in (key, "created_at") else F.col(f"_r.`{c}`").alias(c) for c in columns])


def latest(spark: SparkSession, root: str, after: int | None = None, upto: int | None = None, key: str = "id") -> DataFrame:
    """The table: per key the row of its newest epoch, ``created_at`` of its first.

    The first epoch, the large one after a ``rewrite``, holds a key once: of it
    the rows stay whose key no later epoch has.  Only the later epochs are
    aggregated; against their keys the first is joined, so where they are few
    (AQE measures them) its rows are not shuffled.  A single later epoch holds a
    key once as well, so it is not aggregated.  One epoch is a scan.
    """
    rows = read(spark, root, after, upto)
    found = finished(spark, root, after, upto)
    if len(found) == 1:
        return rows.drop("epoch")
    # read apart, so that each side's size is that of its own files when the join is planned
    base = spark.read.schema(rows.drop("epoch").schema).parquet(_folder(root, found[0]))
    later = read(spark, root, after=found[0], upto=upto)
    later = later.drop("epoch") if len(found) == 2 else _newest(later, key)
    replaced = later.select(F.col(f"`{key}`").alias("_key"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key"))
    first_stamps = base.join(replaced, same).select("_key", F.col("created_at").alias("_first"))
    kept = base.join(replaced, same, "left_anti")
    restamped = later.join(first_stamps, same, "left").withColumn("created_at", F.coalesce("_first", "created_at"))
    return kept.unionByName(restamped.drop("_key", "_first"))


def insert_new(rows: DataFrame, root: str, epoch: int, now=None, key: str = "id", order: list[str] | None = None,
               reread: bool = False) -> int:
    """Store only the keys that no earlier epoch holds (an anti-join on the key column alone).

    ``reread`` as in ``append``: the key column alone tells first which keys are
    new, and whole rows are shuffled only where those are many.
    """
    spark = rows.sparkSession
    if not finished(spark, root, upto=epoch - 1):
        return append(rows, root, epoch, now, key, order, reread=reread)
    held = read(spark, root, upto=epoch - 1)
    if not reread:
        return append(delete_by_id(rows, held, key), root, epoch, now, key, order)
    new = keys_not_in(rows, held, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return append(keep_keys(rows, new, new.count(), key), root, epoch, now, key, order, reread=True)
    finally:
        new.unpersist()


def rewrite(spark: SparkSession, root: str, fresh: str, without: DataFrame | None = None, key: str = "id") -> str:
    """Fold the epochs into one, under the newest number, in the folder ``fresh``;
    the keys of ``without`` go (U04).  Both stamps of the kept rows stay."""
    if fresh.rstrip("/") == root.rstrip("/"):
        raise ValueError("a table is rewritten into a fresh folder")
    newest = finished(spark, root)
    table = latest(spark, root, upto=newest[-1] if newest else None, key=key)
    if without is not None:
        table = delete_by_id(table, without, key)
    with shuffles_removed(spark):
        table.write.mode("overwrite").option("compression", "zstd").parquet(_folder(fresh, newest[-1]))
    return fresh


def changes(spark: SparkSession, root: str, old: int, new: int, at, key: str = "id", actor: str = "system",
            include_noop: bool = False) -> DataFrame:
    """U07 from epoch ``old`` to ``new``: the new rows come from the epochs in
    between alone, the old ones are cut to the same keys before they are compared."""
    later = latest(spark, root, after=old, upto=new, key=key).drop(*STAMPS)
    touched = read(spark, root, after=old, upto=new).select(key).distinct()
    before = latest(spark, root, upto=old, key=key).drop(*STAMPS).join(touched, key, "left_semi")
    return audit_feed(before, later, at, key, actor=actor, include_noop=include_noop)
