"""Search of stored postings by an index of trigrams.

The index of a Parquet table holds, per trigram of a lower-cased text column,
file of the table and chunk of the file, the numbers of the rows that contain
it.  A pattern of ``ILIKE`` is cut at its wildcards into runs; a row that
matches holds every trigram of every run, so intersecting the row lists gives
candidates that miss no hit.  Only the files with candidates are read, and the
predicate itself decides on the candidate rows.  A pattern without a run of
three characters says nothing about trigrams: its predicate then stands on the
whole table.

Lower-casing is ``lower`` of the session on both sides, as ``ILIKE`` does it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as R

TEXT_COLUMNS = ("title", "description", "locations", "company_name_en", "company_name_fa")
CHUNK = 32_768  # rows; bounds a row list
STEP_CHARS = 2_000_000  # of texts whose trigrams are sorted at once
_RUN = r"%|_|\\."  # what ends a run: wildcards, and an escape with what it escapes
_LISTS = "gram string, column string, file string, chunk int, rows array<int>"
#: Row lists ascend, so their numbers are stored as differences.
_STORED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#rows.list.element": "false"}


def _gram_lists(column: str):
    """The per-partition function of the index: rows (file, chunk, row, text) -> row lists of the trigrams of consecutive texts.

    A trigram is three code points, packed into one number.  Built as a closure
    so it is shipped to Python workers by value.
    """
    def lists(file: str, chunk: int, rows: list, texts: list):
        import numpy as np
        import pyarrow as pa

        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.array([len(t) for t in texts])
        whole = np.arange(len(points)) < np.repeat(np.cumsum(lengths) - 2, lengths)  # a trigram lies in one text
        at = np.flatnonzero(whole)
        if not len(at):
            return None
        code = points[at] << 42 | points[at + 1] << 21 | points[at + 2]
        row = np.repeat(np.array(rows, np.int32), lengths)[at]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]  # of one trigram the rows ascend
        first = np.append(True, code[1:] != code[:-1])
        once = first | np.append(True, row[1:] != row[:-1])
        code, row, first = code[once], row[once], np.flatnonzero(first[once])
        low = (1 << 21) - 1
        grams = [chr(c >> 42) + chr(c >> 21 & low) + chr(c & low) for c in code[first].tolist()]
        n = len(grams)
        held = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(row, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(grams), pa.array([column] * n), pa.array([file] * n), pa.array([chunk] * n, pa.int32()), held],
            names=["gram", "column", "file", "chunk", "rows"])

    def found(batches):
        place, rows, texts, size = None, [], [], 0
        for batch in batches:
            for file, chunk, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and ((file, chunk) != place or size >= STEP_CHARS):
                    made = lists(*place, rows, texts)
                    if made is not None:
                        yield made
                    rows, texts, size = [], [], 0
                place, text = (file, chunk), text.decode("utf-8", "replace")
                rows.append(row)
                texts.append(text)
                size += len(text)
        if rows and (made := lists(*place, rows, texts)) is not None:
            yield made

    return found


def _joined_lists():
    """The per-partition function that joins the lists of one trigram, column, file and chunk that follow each other in a batch."""
    def joined(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, rows = batch.columns
            first = np.ones(batch.num_rows, bool)
            for k in keys:
                other = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
                first[1:] = other if k is keys[0] else first[1:] | other
            at, ends = np.flatnonzero(first), rows.offsets.to_numpy()
            held = pa.ListArray.from_arrays(pa.array(np.append(ends[at], ends[-1]) - ends[0], pa.int32()), rows.flatten())
            yield pa.RecordBatch.from_arrays([*[k.take(pa.array(at)) for k in keys], held], names=batch.schema.names)

    return joined


def build_index(spark: SparkSession, table: str, index: str, columns=TEXT_COLUMNS) -> str:
    """Writes the index of the Parquet table at ``table``; nulls have no trigrams.

    Rows are numbered by file and place in it, so the table is neither changed
    nor copied.  Each task joins the trigrams of consecutive rows to lists, sorts
    its lists by trigram, joins them again and writes them: nothing is shuffled,
    and a lookup reads of each file the pages of its trigrams.  Of a trigram, file
    and chunk there may be several lists, without a row in common; a trigram of
    every row is spread over all chunks.
    """
    src = spark.read.parquet(table)
    row = F.col("_metadata.row_index")
    parts = [src.where(F.length(c) >= 3).select(
        F.col("_metadata.file_path").alias("file"), F.floor(row / CHUNK).cast("int").alias("chunk"), (row % CHUNK).cast("int").alias("row"),
        F.lower(c).cast("binary").alias("text")).mapInArrow(_gram_lists(c), _LISTS) for c in columns if c in src.columns]
    lists = functools.reduce(DataFrame.unionByName, parts).sortWithinPartitions("gram", "column", "file", "chunk", F.col("rows")[0])
    lists.mapInArrow(_joined_lists(), _LISTS).write.mode("errorifexists").options(**_STORED).parquet(index)
    return index


def needed_grams(spark: SparkSession, texts: list[str]) -> list[list[str]]:
    """The trigrams that a match of ``ILIKE '%text%'`` must hold, for each text (none: any row may match)."""
    asked = spark.createDataFrame([(i, f"%{t}%") for i, t in enumerate(texts)], "i int, text string")
    runs = asked.select("i", F.split(F.lower(F.col("text")), _RUN).alias("runs")).orderBy("i").collect()
    return [sorted({run[k:k + 3] for run in r["runs"] for k in range(len(run) - 2)}) for r in runs]


def _candidates(lists: DataFrame, columns, grams: list[str]) -> DataFrame:
    """Lists (file, chunk, rows) of the rows that hold all ``grams`` in one of ``columns``; a group has the lists of one chunk's few trigrams."""
    asked = lists.where(F.col("gram").isin(grams) & F.col("column").isin(list(columns)))
    held = asked.groupBy("column", "file", "chunk").agg(F.collect_list(F.struct("gram", "rows")).alias("lists"))

    def rows_of(gram: str) -> Column:
        return F.flatten(F.transform(F.filter("lists", lambda x: x["gram"] == gram), lambda x: x["rows"]))

    both = held.select("file", "chunk", functools.reduce(F.array_intersect, [F.array_distinct(rows_of(g)) for g in grams]).alias("rows"))
    return both.where(F.size("rows") > 0).groupBy("file", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("rows"))).alias("rows"))


def candidate_rows(spark: SparkSession, index: str, asked: list[tuple[str, tuple[str, ...]]]) -> DataFrame | None:
    """Rows that may match every (text, columns) of ``asked``; None where no text has a trigram."""
    lists = spark.read.parquet(index)
    grams = needed_grams(spark, [text for text, _ in asked])
    parts = [_candidates(lists, columns, g) for (_, columns), g in zip(asked, grams) if g]
    if not parts:
        return None
    # Lists are intersected chunk by chunk; only what is left becomes rows.
    left = functools.reduce(lambda a, b: a.withColumnRenamed("rows", "_rows").join(b, ["file", "chunk"]).select(
        "file", "chunk", F.array_intersect("_rows", "rows").alias("rows")), parts)
    return left.select("file", "chunk", F.explode("rows").alias("row"))


def matching_rows(spark: SparkSession, table: str, index: str, keyword: str | None = None, location: str | None = None,
                  company: str | None = None, days=None, as_of=None) -> DataFrame:
    """The rows of ``table`` that ``search_filter`` keeps, by the index.

    Only names of files come to the driver, never more than the table has.
    """
    asked = [(text, columns) for text, columns in (
        (keyword, ("title", "description")), (location, ("locations",)), (company, ("company_name_en", "company_name_fa"))) if text]
    wanted = R.search_filter(keyword, location, company, days, as_of)
    whole = spark.read.parquet(table)
    found = candidate_rows(spark, index, asked) if asked else None
    if found is None:
        return whole.where(wanted)
    files = [r["file"] for r in found.select("file").distinct().collect()]
    if not files:
        return whole.limit(0)
    row = F.col("_metadata.row_index")
    read = spark.read.schema(whole.schema).parquet(*files).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.floor(row / CHUNK).cast("int").alias("_chunk"),
        (row % CHUNK).cast("int").alias("_row"))
    same = ((read["_file"] == found["file"]) & (read["_chunk"] == found["chunk"]) & (read["_row"] == found["row"]))
    return read.join(found, same, "left_semi").drop("_file", "_chunk", "_row").where(wanted)


def search_indexed(spark: SparkSession, table: str, index: str, keyword=None, location=None, company=None, days=None,
                   sort: str = "date", page: int = 1, limit: int = 25, as_of=None, most: int | None = None):
    """R03 by the index: the same page and total as ``search.search`` on the table."""
    limit, page = R.page_size(limit, most), max(1, int(page))
    hits = matching_rows(spark, table, index, keyword, location, company, days, as_of)
    return (hits.orderBy(*R.search_order(sort, keyword)).offset((page - 1) * limit).limit(limit),
            hits.agg(F.count(F.lit(1)).alias("total")))
