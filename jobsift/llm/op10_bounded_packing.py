"""Packing (10): bounded-space online packing into fixed windows.

Each partition keeps at most ``open_windows`` windows open.  A text's ids and
a closing id arrive in the partition's order; whole windows of an overlong
text are emitted at once, the rest goes into the open window that it leaves
fullest (best fit).  When none has room the fullest window is emitted and a
new one opened.  The windows still open at a partition's end, a bounded number
of rows, meet with those of neighbouring partitions and are merged: laid end
to end, cut at the capacity, and what remains is cut at powers of two, so that
it needs no padding.

Defined results: null and empty texts are the closing id alone; repeated rows
are packed each; a null doc_id stays null; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import by_value, documents, stored, whole_text
from jobsift.llm.word_ids import default_tokenizer, word_ids

CAPACITY = 4096
CLOSING_ID = 2
OPEN_WINDOWS = 64
#: Partitions whose leftovers one task merges.
MERGED_PARTITIONS = 4
#: Sequence numbers: partition (or merging group) in the high half; merged ones lie above all others.
MERGED_BASE = 1 << 30

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PLACED = PIECE + ", part long, open boolean"


class Windows:
    """The open windows of one partition, and what they emit."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending: the fullest first
        self.pieces: dict[int, list[tuple]] = {}
        self.number = 0
        self.emitted: list[tuple[int, tuple]] = []

    def emit(self, pieces: list[tuple]) -> None:
        self.emitted += [(self.number, p) for p in pieces]
        self.number += 1

    def add(self, doc_id, ids: bytes) -> None:
        n, step = len(ids) // 4, self.capacity
        whole = n - n % step
        for start in range(0, whole, step):
            self.emit([(doc_id, start, ids[4 * start:4 * (start + step)], n)])
        if n > whole:
            self.place((doc_id, whole, ids[4 * whole:], n), n - whole)

    def place(self, piece: tuple, need: int) -> None:
        at = bisect_left(self.free, (need, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                self.emit(self.pieces.pop(self.free.pop(0)[1]))
            free, window = self.capacity, max(self.pieces, default=-1) + 1
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if free == need:
            self.emit(self.pieces.pop(window))
        else:
            insort(self.free, (free - need, window))

    def taken(self, part: int) -> list[tuple]:
        """Rows of the windows emitted so far."""
        rows, at, last = [], 0, None
        for window, (doc_id, start, ids, n) in self.emitted:
            at = at if window == last else 0
            rows.append((doc_id, start, len(ids) // 4, ids, n, (part << 32) + window, at, part, False))
            at, last = at + len(ids) // 4, window
        self.emitted = []
        return rows

    def left(self, part: int) -> list[tuple]:
        return [(doc_id, start, len(ids) // 4, ids, n, window, k, part, True) for window, pieces in sorted(self.pieces.items())
                for k, (doc_id, start, ids, n) in enumerate(pieces)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def merge_leftovers(rows: list[tuple], group: int, capacity: int) -> list[tuple]:
    """End to end, cut at the capacity; the tail is cut at powers of two."""
    total = sum(r[2] for r in rows)
    cuts = [capacity] * (total // capacity)
    tail = total % capacity
    cuts += [1 << b for b in range(capacity.bit_length(), -1, -1) if tail >> b & 1]
    out, number, at = [], 0, 0
    for doc_id, start, length, ids, n, *_ in rows:
        done = 0
        while done < length:
            take = min(length - done, cuts[number] - at)
            out.append((doc_id, start + done, take, ids[4 * done:4 * (done + take)], n, ((MERGED_BASE + group) << 32) + number, at))
            done, at = done + take, at + take
            if at == cuts[number]:
                number, at = number + 1, 0
    return out


def pack_windows(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS,
                 closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of all texts with their ids (little-endian unsigned 32-bit) and places.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids, doc_tokens, sequence_id, offset.  ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark, path, closing = docs.sparkSession, tokenizer or default_tokenizer(), np.array([closing_id], "<u4").tobytes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, windows, schema = TaskContext.get().partitionId(), Windows(capacity, open_windows), _arrow(PLACED)
        words = word_ids(path)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                windows.add(doc_id, words.of(text) + closing)
                if len(windows.emitted) >= 2000:
                    yield _batch(windows.taken(part), schema)
        yield _batch(windows.taken(part) + windows.left(part), schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("part", "sequence_id", "offset")])
        rows = list(zip(*(table.column(f.name).to_pylist() for f in _arrow(PIECE)), strict=True))
        return pa.Table.from_batches([_batch(merge_leftovers(rows, key[0].as_py(), capacity), _arrow(PIECE))])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    placed = stored(spark, texts.mapInArrow(place, PLACED), "packed")
    names = [f.name for f in _arrow(PIECE)]
    merged = (placed.where("open").groupBy(F.expr(f"part div {MERGED_PARTITIONS}").alias("_op_group"))
              .applyInArrow(merge, PIECE))
    return placed.where("not open").select(*names).unionByName(merged.select(*names))


@register("op10_bounded_packing")
def op10_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


by_value(__name__)
