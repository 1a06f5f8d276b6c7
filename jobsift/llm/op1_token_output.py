"""Token-ID / binary output (1): best-fit-decreasing packing.

A task reads its partition in blocks of about ``block_tokens`` ids.  In a
block, whole rows of overlong texts come first; every rest is then placed,
longest first, into the row whose free space is the smallest that holds it,
which a segment tree over the free capacities finds in logarithmic time.  Each
packed row is one line of the id matrix, with the cumulative lengths of its
segments and position ids that start anew at every segment.

Defined results: null and empty texts are the closing id alone; repeated rows
are packed each; a null doc_id stays null; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import by_value, documents, whole_text
from jobsift.llm.word_ids import default_tokenizer, word_ids

CAPACITY = 4096
#: <|endoftext|> of word_bpe_49k.json; it also fills the rest of a row.
CLOSING_ID = 49407
#: Ids that one block holds in memory.
BLOCK_TOKENS = 4_000_000

PACKED = ("sequence_id long, ids binary, position_ids binary, n_tokens int, cu_seqlens array<int>, "
          "doc_ids array<long>, starts array<long>")


class CapacityTree:
    """Rows by free space: the smallest free space of at least some need."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free, row) with the least free >= need."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        self._change(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of every row, by number; each length is 1 to capacity."""
    tree, rows = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free, row = tree.take(lengths[item]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(item)
        if free > lengths[item]:
            tree.add(free - lengths[item], row)
    return rows


def number_kind(tokenizer: str, capacity: int, closing_id: int, wide: bool | None) -> str:
    """The numpy kind that holds every id of the tokenizer and every place in a row."""
    from tokenizers import Tokenizer

    most = max(*Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), closing_id, capacity - 1)
    if wide is False and most >= 1 << 16:
        raise ValueError(f"numbers up to {most} do not fit into 16 bits")
    return "<u4" if wide or most >= 1 << 16 else "<u2"


def pack_block(texts: list[tuple], capacity: int, fill: int, kind: str) -> Iterator[tuple]:
    """Rows (ids, position_ids, n_tokens, cu_seqlens, doc_ids, starts) of (doc_id, ids) texts."""
    pieces = [(doc_id, start, ids[start:start + capacity]) for doc_id, ids in texts for start in range(0, len(ids), capacity)]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], capacity):
        ids, places, ends = np.full(capacity, fill, kind), np.zeros(capacity, kind), [0]
        for item in row:
            n = len(pieces[item][2])
            ids[ends[-1]:ends[-1] + n] = pieces[item][2]
            places[ends[-1]:ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        yield ids.tobytes(), places.tobytes(), ends[-1], ends, [pieces[i][0] for i in row], [pieces[i][1] for i in row]


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
                  block_tokens: int = BLOCK_TOKENS, wide: bool | None = None) -> DataFrame:
    """One row per packed sequence.

    ids, position_ids: ``capacity`` little-endian unsigned numbers of 16 bits, or
    32 where the vocabulary, the closing id or the capacity need more (or if
    ``wide``; ``wide=False`` raises where 16 bits are too few); cu_seqlens:
    cumulative segment lengths from 0; doc_ids, starts: each segment's document
    and its first id there.  Ids of all segments of a document, by start, are
    its whole text's ids and the closing id.
    """
    path = tokenizer or default_tokenizer()
    kind = number_kind(path, capacity, closing_id, wide)
    schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("position_ids", pa.binary()), ("n_tokens", pa.int32()),
                        ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number, words = TaskContext.get().partitionId() << 32, 0, word_ids(path)
        block: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            rows = []
            for row in pack_block(block, capacity, closing_id, kind):
                rows.append((first + number, *row))
                number += 1
                if len(rows) == 500:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            block.clear()
            held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(words.of(text), "<u4"), closing_id).astype(kind)
                block.append((doc_id, ids))
                held += len(ids)
                if held >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(pack, PACKED)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files; a file's rows, in order, are one id matrix."""
    packed.write.option("compression", "zstd").parquet(path)


def matrix(rows: pa.Table | list, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The id and position matrices (one line a row, ``capacity`` numbers each) of rows of a written file."""
    out = []
    for name in ("ids", "position_ids"):
        data = [r[name] for r in (rows.to_pylist() if isinstance(rows, pa.Table) else rows)]
        kind = f"<u{len(data[0]) // capacity}" if data else "<u2"
        out.append(np.frombuffer(b"".join(data), kind).reshape(len(data), capacity))
    return out[0], out[1]


@register("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(documents(spark, sf_dir))


by_value(__name__)
