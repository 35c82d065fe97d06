"""Numbering, running sums and neighbours in an order over the whole table, or over few large keys, by range partitions.

A window over five keys is five tasks. Here the rows are range-partitioned by key and order and written, so that a
partition is a stretch of the order; each stretch is numbered by itself, and what earlier stretches add (their counts,
sums, last values) comes from a table of one row per stretch and key, which is bounded by partitions plus keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.sources.shared import settled


def stretches(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df as a stored table with `part`: rows of a part come before those of later parts in the order of the given columns.
    parts: their number; else Spark chooses by size."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return settled(ranged.withColumn("part", F.spark_partition_id()), "stretches")


def _earlier(rows: DataFrame, key: list[str], **aggs: Column) -> tuple[DataFrame, Window]:
    """One row per part and key with the given aggregates, and the window over the parts of a key."""
    table = rows.groupBy("part", *key).agg(*(v.alias(k) for k, v in aggs.items()))
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))  # as many rows as there are parts
    return table, w


def _joined(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the columns of their part and key; a null key is a key."""
    table = table.withColumnsRenamed({c: f"_{c}" for c in ["part", *key]})
    on = F.col("part") == F.col("_part")
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(table, on).drop("part", *(f"_{c}" for c in ["part", *key]))


def numbered(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with rn (from 1, in the order, within the key) and total (rows of the key)."""
    rows = stretches(df, [*key, *order], parts)
    table, w = _earlier(rows, key, n=F.count(F.lit(1)))
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = table.select("part", *key, before.alias("before"), F.sum("n").over(w).alias("total"))
    local = F.row_number().over(Window.partitionBy("part", *key).orderBy(*order))
    return _joined(rows.withColumn("rn", local), table, key).withColumn("rn", F.col("rn") + F.col("before")).drop("before")


def with_previous(df: DataFrame, key: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with `before`: the value of the row before, in the order, within the key; null for the first."""
    rows = stretches(df, [*key, *order], parts)
    table, w = _earlier(rows, key, last=F.max_by(F.struct(value), F.struct(*order)))
    table = table.select("part", *key, F.lag("last").over(w.orderBy("part")).alias("last"))
    here = Window.partitionBy("part", *key).orderBy(*order)
    out = _joined(rows.withColumns({"before": F.lag(value).over(here), "first": F.row_number().over(here) == 1}), table, key)
    return out.withColumn("before", F.when(F.col("first"), F.col(f"last.{value}")).otherwise(F.col("before"))).drop("first", "last")


def running_sum(df: DataFrame, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with `running`: the sum of the values up to and with each row, in an order over the whole table."""
    rows = stretches(df, order, parts)
    table, w = _earlier(rows, [], n=F.sum(value))
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = table.select("part", before.alias("earlier"))
    local = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(rows.withColumn("running", local), table, []).withColumn("running", F.col("running") + F.col("earlier")).drop("earlier")
