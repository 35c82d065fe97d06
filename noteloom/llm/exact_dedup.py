"""Exact dedup through an extendible-hash index kept on shared files (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z. The key of a text is its 64-bit hash. Directory
entries are the leading bits of the key; a bucket that holds more than `capacity` distinct texts is
split by its next bit, which doubles the directory when the bucket was as deep as the directory.

Building: copies are folded by their bytes on the way to the owners, so a hot text sends one row per
task. Tasks own ranges of buckets; an owner chains the texts of a bucket that have one key.
Probing: a row goes from its key to its slot, from the slot to the bucket, and in the bucket to the chain of
its key. A chain of one text is the row's own text, because the owner has compared the bytes of all texts with that
key. In a longer chain, where keys collide, the row's bytes are compared with each text of it.

Defined results: null text counts as empty; empty texts are equal to each other; repeated rows (the
same id twice) are members of their group like any other row; a null id is the smallest id; an empty
table gives an empty result; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.llm.common import ascii_lower, stored, table

CAPACITY = 8192


def _prefix(bits: int):
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (normalised) and key (64-bit hash) of each row."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def entries(rows: DataFrame) -> DataFrame:
    """One row per distinct text. Grouping is by the bytes themselves, so a collision of keys never
    merges texts; copies are summed on the map side, so a hot text sends one row per task."""
    return (
        rows.groupBy("key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size")
    )


def directory(index: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Double the directory until no bucket is overfull: (slot, bucket, depth) rows, and the global depth.

    The rounds work on a table of counts by leading bits, a few hundredths of the index, and only
    the fact that some bucket is overfull comes to the driver.
    """
    n = index.count()
    bits = 4 + max(0, math.ceil(math.log2(max(n, 1) / capacity)))
    while True:
        counts = stored(index.groupBy(_prefix(bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        if bits >= 60 or counts.filter(F.col("n") > capacity).isEmpty():
            break
        bits += 4
    depth, closed, overfull = 0, [], None
    while True:
        level = counts.groupBy(F.shiftrightunsigned("cell", bits - depth).alias("prefix")).agg(F.sum("n").alias("n"))
        if overfull is not None:
            level = level.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(
                overfull.select(F.col("prefix").alias("parent")), "parent", "left_semi"
            ).drop("parent")
        level = stored(level, "buckets")
        closed.append(level.filter((F.col("n") <= capacity) | F.lit(depth == bits)).withColumn("depth", F.lit(depth)))
        overfull = level.filter(F.col("n") > capacity)
        if depth == bits or overfull.isEmpty():
            break
        depth += 1
    buckets = closed[0]
    for more in closed[1:]:
        buckets = buckets.unionByName(more)
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
    return buckets.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "depth"), depth


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index table (bucket, key, chain: place among the texts of equal key, length: how many these are, digest, keep_id,
    group_size), its directory (slot, bucket, depth) and the directory's depth."""
    distinct = stored(entries(rows), "entries")
    slots, depth = directory(distinct, capacity)
    slots = stored(slots, "directory")
    chain = Window.partitionBy("bucket", "key")
    owned = (
        distinct.withColumn("slot", _prefix(depth))
        .join(slots, "slot")
        .repartitionByRange("bucket")
        .withColumns({"chain": F.row_number().over(chain.orderBy("digest")), "length": F.count(F.lit(1)).over(chain)})
    )
    return stored(owned.select("bucket", "key", "chain", "length", "digest", "keep_id", "group_size"), "index"), slots, depth


def probe(rows: DataFrame, index: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The entry of each row (doc_id, text, key): doc_id, digest, keep_id, group_size."""
    routed = rows.withColumn("slot", _prefix(depth)).join(slots.select("slot", "bucket"), "slot")
    entry = ["digest", "keep_id", "group_size"]
    out = routed.select("bucket", "key", "doc_id").join(index.filter("length = 1"), ["bucket", "key"]).select("doc_id", *entry)
    chains = index.filter("length > 1")
    if chains.isEmpty():
        return out
    met = routed.join(chains.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi").select("bucket", "key", "doc_id", "text")
    texts = met.select("bucket", "key", "text").distinct().withColumn("digest", F.unhex(F.sha2("text", 256)))
    chained = chains.join(texts.withColumnRenamed("text", "bytes"), ["bucket", "key", "digest"])
    return out.unionByName(met.join(chained, ["bucket", "key"]).filter(F.col("text") == F.col("bytes")).select("doc_id", *entry))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts stays (all of them, if that id repeats). A hot
    key's rows are probes only, without their text, and Spark splits that side of the join.
    """
    rows = keyed(docs, id_col, text_col)
    return probe(rows, *build_index(rows, capacity)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with their columns as they were."""
    kept = exact_dedup(docs, capacity=capacity).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return out


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
