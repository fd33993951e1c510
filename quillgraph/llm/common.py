"""What the operators share: tables, the shared folder, written intermediate tables, files on it.

Executors and the driver share only the folder named in ``spark.checkpoint.dir`` and the inputs,
so everything that must outlive a stage is written there, never to a local temporary folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import filesystem, make_dir, whole_file
from ..functions.session import materialize, shared_dir, shuffle_partitions
from ..sources.graphs import table

__all__ = ["WORD", "filesystem", "fresh", "make_dir", "materialize", "pylist", "rows_of", "shared_dir", "shuffle_partitions", "small_batches", "small_side", "table", "text_rows", "whole_file"]

#: A word: a run of bytes other than space and the ASCII controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def small_side(df: DataFrame, name: str, most: int = 200_000) -> DataFrame:
    """The written table, to be broadcast if it has at most so many rows (counted), else to be joined as Spark sees fit."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= most else df


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, nulls of ``text`` read as the empty text; for operators that hand texts to Python."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col("text"), F.lit("")).alias("text") if c == "text" else F.col(c) for c in columns])


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows in an Arrow batch: texts are long, and a Python worker holds a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def rows_of(batch: pa.RecordBatch, most_bytes: int = 32 << 20, column: str = "text"):
    """Cuts an Arrow batch so that very long texts do not pile up in one Python list."""
    size = batch.column(column).nbytes
    step = max(1, int(len(batch) * most_bytes / max(size, 1)))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def pylist(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
