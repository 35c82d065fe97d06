"""What the corpus operators share: reading tables, and cutting lineage on storage every executor sees."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.sources.shared import folder, settled

MOST_SENT = 1 << 19  # numbers of a table that goes through the driver to all tasks: some 20 MB there


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or archive in the shared folder."""
    return folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, so a
    lost executor costs a re-read and not a recomputation, and every later job sees the same rows."""
    return settled(df, name)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables of which no later job reads anything, and the shuffle files of finished jobs: Spark's cleaner
    looks for these only when the driver's JVM collects garbage, so it is asked to."""
    if not hasattr(spark, "_jvm"):
        return
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled. Left to itself Spark sends a table to all tasks by the bytes of its
    files; 10 MB of packed numbers are a hundred in the driver, which builds the table, and a query has many."""
    return df.hint("merge")


def spread_by_hash(df: DataFrame) -> DataFrame:
    """The same for a side of few bytes a row, beside texts: a partition of it is held, so the texts aren't sorted."""
    return df.hint("shuffle_hash")


def sent(df: DataFrame, cells: Column | None = None, most: int | None = None, beyond: Callable[[DataFrame], DataFrame] = spread) -> DataFrame:
    """A stored side of a join: sent to all tasks if it has few numbers (cells: those of a row, if there are lists), else spread()."""
    total = df.agg(F.sum(F.lit(len(df.columns)) if cells is None else cells + len(df.columns))).first()[0] or 0
    return F.broadcast(df) if total <= (MOST_SENT if most is None else most) else beyond(df)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose strings or binaries in a column have about `size` bytes (a piece has one row at least).
    Only a piece is turned into Python objects at a time."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(lengths), 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def released() -> None:
    """Give back to the system what this Python process has freed. Python workers outlive their tasks, so what they keep counts
    beside the memory of later tasks of their executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """For mapInArrow: run, and released() at its end."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return done


def tidy_group(run: Callable) -> Callable:
    """For applyInPandas of a group: run, and released() at its end."""

    def done(rows):
        out = run(rows)
        released()
        return out

    return done


def tidy_groups(run: Callable) -> Callable:
    """For applyInPandas of a cogroup: run, and released() at its end."""

    def done(left, right):
        out = run(left, right)
        released()
        return out

    return done


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() also maps other letters, so it serves only texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
