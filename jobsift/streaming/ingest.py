"""Structured Streaming ingestion.

Landed API response files are the stream: ``readStream`` over a folder with a
declared schema (never inference), one posting per row after the envelope is
exploded.  Inside ``foreachBatch`` each micro-batch is cleaned and de-duplicated
and stored as one epoch: of the table, of the batch files, of the set-apart
pages and rows, and of the ledger.  The checkpoint replaces the reference's
queue and resume-state file; a replayed epoch writes its own folders again, so
it adds nothing twice.
"""

from __future__ import annotations

import datetime as _dt
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as CO
from ..operators import epochs as EP
from ..operators.merge import delete_by_id
from ..session import shuffles_removed
from ..sources import api as API
from ..sources import sinks as K

LEDGER = ("batch_id long, event_seq long, event_time timestamp_ntz, status string, row_count long, "
          "processing_time double, error_message string, malformed_pages long, invalid_rows long")


def stream_pages(spark: SparkSession, landing: str, max_files_per_trigger: int = 1) -> DataFrame:
    """One row per posting, page by page, from landed response files."""
    raw = (spark.readStream.schema(API.ENVELOPE).option("maxFilesPerTrigger", max_files_per_trigger)
           .json(landing))
    return API.explode_envelopes(raw)


def clean_batch(landed: DataFrame, batch_id: str) -> DataFrame:
    """Landed pages -> cleaned table rows with ``reject_reason`` / ``is_valid`` and the arrival order ``_page``, ``_position``.

    The salary bounds that the API gives win over those read from the salary text.
    """
    bounds = {f"normalize_salary_{side}": f"_api_{side}" for side in ("min", "max")}
    records = API.explode_envelopes(landed).withColumnsRenamed({"page": "_page", "position": "_position"})
    flat = API.flatten_posting(records, batch_id, keep=("_page", "_position")).drop("batch_date").withColumnsRenamed(bounds)
    cleaned = CO.clean_postings(flat)
    return cleaned.withColumns({c: F.coalesce(api, c) for c, api in bounds.items()}).drop(*bounds.values())


def ingest_batch(table: str, ledger_path: str, quarantine_path: str | None = None, files_root: str | None = None,
                 first_epoch: int = 0):
    """The ``foreachBatch`` body.

    The ledger gets ``processing``, then ``completed`` with the counts or
    ``failed`` with the error, which is raised again: the stream stops, and a
    restart replays the epoch.  Malformed pages and postings that fail the
    cleaning rules go to ``quarantine_path`` whole; with ``files_root`` the
    stored rows are also kept as batch files (K06).  The last arrival of an id
    in the batch is stored (D9).
    """
    quarantine = quarantine_path or ledger_path + "_quarantine"
    counted = F.count(F.lit(1)).alias("n")

    def run(landed: DataFrame, epoch_id: int) -> None:
        spark, epoch, began = landed.sparkSession, first_epoch + int(epoch_id), time.monotonic()

        def event(seq: int, status: str, rows=None, error=None, bad=None, invalid=None) -> None:
            row = (epoch, seq, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), status, rows,
                   time.monotonic() - began if seq else None, error, bad, invalid)
            # a folder for each event of an epoch: a replay overwrites its own
            spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger_path}/epoch={epoch}/event={seq}")

        def kept_apart(rows, count: Observation, kind: str) -> None:
            rows.observe(count, counted).write.mode("overwrite").option("compression", "zstd").parquet(f"{quarantine}/{kind}/epoch={epoch}")

        event(0, "processing")
        # Not persisted: the landed pages are small beside the cleaned rows, and each write reads them again.  Each
        # observes the rows before its filter, which would else be pushed down and clean a row once more.
        cleaned = clean_batch(landed, f"epoch-{epoch}")
        try:
            stored, bad, invalid = Observation(), Observation(), Observation()  # counted by the writes themselves
            with shuffles_removed(spark):
                kept_apart(API.malformed(landed), bad, "pages")
                kept_apart(cleaned.observe(Observation(), counted).where(~F.col("is_valid")), invalid, "rows")
                valid = cleaned.observe(Observation(), counted).where("is_valid").drop("is_valid", "reject_reason")
                EP.append(valid, table, epoch, order=["_page", "_position"], counted=stored)
                if files_root:
                    K.write_batch_triple(spark.read.parquet(f"{table}/epoch={epoch}"), f"{files_root}/epoch={epoch}", epoch,
                                         _dt.datetime.fromtimestamp(0), mode="overwrite")
            event(1, "completed", stored.get["n"], None, bad.get["n"], invalid.get["n"])
        except Exception as error:
            event(1, "failed", error=str(error))
            raise
    return run


def stream_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, ledger_path: str,
                  max_files_per_trigger: int = 1, **batch):
    """Landed pages -> micro-batches -> epochs of the table + ledger;
    ``availableNow`` processes everything landed so far and stops (T03: a restart
    with the same checkpoint only sees files that arrived since).  ``batch`` goes
    to ``ingest_batch``.  Fold the epochs with ``epochs.rewrite`` when they get many."""
    landed = spark.readStream.schema(API.LANDED).option("maxFilesPerTrigger", max_files_per_trigger).json(landing)
    q = (landed.writeStream
         .foreachBatch(ingest_batch(table, ledger_path, **batch))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The ledger events of all epochs; ``ledger.ledger_state`` folds them per batch."""
    return spark.read.schema(LEDGER).parquet(ledger_path).select(*[c.split()[0] for c in LEDGER.split(", ")])


def stream_dedupe(events: DataFrame, key: str = "id", time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Drop ids seen earlier; the watermark bounds the state (it replaces
    the reference's 10,000-id cache).  ``time`` must be TIMESTAMP (not NTZ)."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_dedupe_exact(events: DataFrame, table: str, checkpoint: str, key: str = "id", time: str = "ts", delay: str = "7 days",
                        late: str | None = None):
    """T02 without forgetting: the watermark's state, bounded by ``delay``, drops
    the duplicates that come soon; what it lets through is stored only if no
    epoch of ``table`` (nor of ``late``) holds its key, so one that comes after
    its state is gone is dropped too.  Rows behind the watermark do not pass;
    ``settle_late`` takes them.
    """
    def store(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        if late and EP.finished(spark, late):
            batch = delete_by_id(batch, EP.read(spark, late), key)
        EP.insert_new(batch, table, int(epoch_id) + 1, key=key, order=[time])

    q = (stream_dedupe(events, key, time, delay).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def settle_late(landed: DataFrame, table: str, late: str, key: str = "id", time: str = "ts") -> int:
    """Rows of ``landed`` whose key neither ``table`` nor ``late`` holds become an epoch of ``late``: those that the
    watermark left out before their key was stored.  ``landed`` is what came since the last call, or more; run it
    while the stream is down.  Returns the epoch."""
    spark = landed.sparkSession
    missing = delete_by_id(landed, EP.read(spark, table), key) if EP.finished(spark, table) else landed
    return EP.insert_new(missing.where(F.col(key).isNotNull()), late, EP.next_epoch(spark, late), key=key, order=[time])


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Drain a streaming frame into parquet with ``availableNow`` and wait."""
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
