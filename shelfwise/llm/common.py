"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import CLEANUP, checkpointed, conf_set, ensure_checkpoint_dir

#: What separates words: the ASCII white space that ``bytes.split()`` knows.
SPACE = r"[\x20\x09-\x0D]+"
#: A character that belongs to a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for white space alone."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` needs it in a loop over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def saved(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder of the session and read from there."""
    return checkpointed(df)


def strings(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def rows_of(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch and new ones behind them."""
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + list(new.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a task holds the Python objects of a few texts only."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows whose texts together have at most ``most`` bytes, or of one row with a longer text."""
    for batch in small_batches(batches, rows):
        size = np.cumsum(np.array([len(t) for t in strings(batch.column(column))], dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """A query run inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    return conf_set(spark, **{CLEANUP: "true"})


def table_saved(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Like :func:`saved`, but as a Parquet table in the checkpoint folder, which is far smaller for long tables.

    ``by``: a column of few values, each of which gets a folder of its own, written side by side without a sort.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    with shuffles_freed(spark), conf_set(spark, **{_WRITERS: "8"}) if by else nullcontext():
        df.write.parquet(path, compression=compression, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def table_dropped(df: DataFrame) -> None:
    """Delete the Parquet table of :func:`table_saved` that ``df`` reads, where nothing will read it again."""
    spark = df.sparkSession
    for folder in {re.sub(r"(/[^/]*=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:  # the table's, above those of a column's values
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
