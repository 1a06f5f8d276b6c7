"""Helpers shared by the operators of this subpackage.

Conventions: a null text counts as the empty text; operators read only the
columns they name and prefix their own helper columns with ``_op_`` so that
extra columns of the input cannot clash with them.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.session import work_path

#: White space that separates words: code points 0x20 and 0x09 to 0x0D.
WS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_value(module_name: str) -> None:
    """Send a module's task functions to the workers by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def whole_text(col: str | Column = "text") -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(F.split(F.translate(text, WS, " " * len(WS)), " "), "")


def strip_ws(text: Column) -> Column:
    return F.trim(text, F.lit(WS))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def text_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart: the id (null allowed) and 128 bits of the text.

    Rows that agree in them are repeats of one row, with equal results.
    """
    return [doc_id.alias("_op_id"), F.xxhash64(text).alias("_op_h1"), F.xxhash64(F.lit("second"), text).alias("_op_h2")]


def on_key(left: str, right: str) -> Column:
    return ((F.col(f"{left}._op_h1") == F.col(f"{right}._op_h1")) & (F.col(f"{left}._op_h2") == F.col(f"{right}._op_h2"))
            & F.col(f"{left}._op_id").eqNullSafe(F.col(f"{right}._op_id")))


def free_name(columns: list[str], name: str) -> str:
    """A name for a result's own column: ``name``, with as many ``_`` after it as it takes to differ from the input's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a frame below the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(spark, "llm", name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
