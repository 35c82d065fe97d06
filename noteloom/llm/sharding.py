"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt evenly over source parts. A matrix with fixed margins says how many rows each part
sends to each target block: its rows sum to the parts' sizes, its columns to the blocks' sizes, and
it has the law that a uniform permutation would give it. It is drawn from coarse to fine, each step within the margins
of the one before, which keeps the law: parts to shards (16 numbers per part, on the driver), in a shard groups of parts to
blocks (a task per shard), in a group its parts to blocks (a task per shard and group). Each part permutes its
rows and cuts them by its row of the matrix; after the exchange each block permutes what it got. The blocks of a shard
follow one another, so slots are gapless and no task holds a whole shard. With BLOCK_ROWS rows to a block the matrix has
(rows / BLOCK_ROWS)^2 cells: 1.5e7 at 1e9 rows, but 3.6e10, or one for every 1.4 rows, at 5e10; there blocks should have more rows.

Law `rows`: shard counts differ by one at most.

Defined results: null text has no bytes (size 1, crc of nothing); repeated rows are placed one by one;
null ids are placed like others; rows that tie in all of these are placed one by one too; an empty table gives an
empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import stored, table

BLOCK_ROWS = 1 << 18
GROUP_PARTS = 64


def split_evenly(n: int, k: int) -> np.ndarray:
    """k sizes that sum to n, one apart at most."""
    return np.full(k, n // k) + (np.arange(k) < n % k)


def fixed_margins(rows: np.ndarray, cols: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Yield the matrix row by row: each is a multivariate hypergeometric draw from what the columns still need."""
    left = cols.astype(np.int64).copy()
    for n in rows:
        drawn = rng.multivariate_hypergeometric(left, int(n), method="marginals") if n else np.zeros_like(left)
        left -= drawn
        yield drawn


def _group_matrix(seed: int, blocks: int):
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        """For one shard: the counts of its groups of parts, dealt to its blocks."""
        totals = pdf.groupby("group")["n"].sum().sort_index()
        shard = int(pdf["shard"].iloc[0])
        dealt = fixed_margins(totals.to_numpy(), split_evenly(int(totals.sum()), blocks), np.random.default_rng([seed, 1, shard]))
        return pd.DataFrame({"shard": shard, "group": totals.index, "counts": [x.tolist() for x in dealt]})

    return draw


def _block_matrix(seed: int):
    def draw(parts: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        """For one group of parts in one shard: its counts by block, dealt to its parts."""
        parts = parts.sort_values("part")
        shard, at = int(group["shard"].iloc[0]), int(group["group"].iloc[0])
        dealt = fixed_margins(parts["n"].to_numpy(), np.asarray(group["counts"].iloc[0], np.int64), np.random.default_rng([seed, 4, shard, at]))
        return pd.DataFrame({"part": parts["part"], "shard": shard, "counts": [x.tolist() for x in dealt]})

    return draw


def _cut(seed: int, blocks: int):
    def cut(docs: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        """For one part: permute its rows, then give each block as many as its row of the matrix says."""
        docs = docs.sort_values(["doc_id", "no_id", "text_crc32", "size"], ignore_index=True)
        part = int(docs["part"].iloc[0])
        docs = docs.iloc[np.random.default_rng([seed, 2, part]).permutation(len(docs))]
        matrix = matrix.sort_values("shard")
        first = matrix["shard"].to_numpy()[:, None] * blocks + np.arange(blocks)
        docs["block"] = np.repeat(first.ravel(), np.concatenate(matrix["counts"].to_list()))
        return docs[["doc_id", "no_id", "size", "text_crc32", "block"]]

    return cut


def _place(seed: int, blocks: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        """For one block: permute what arrived; slots go on from the shard's earlier blocks."""
        pdf = pdf.sort_values(["doc_id", "no_id", "text_crc32", "size"], ignore_index=True)
        shard, j = divmod(int(pdf["block"].iloc[0]), blocks)
        before = int(split_evenly(int(pdf["shard_rows"].iloc[0]), blocks)[:j].sum())
        pdf["slot"] = before + np.random.default_rng([seed, 3, shard, j]).permutation(len(pdf))
        pdf["shard"] = shard
        return pdf[["doc_id", "no_id", "size", "text_crc32", "shard", "slot"]]

    return place


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs.

    Of the driver: the rows' count, the parts' counts and the part-by-shard matrix (16 numbers per
    `block_rows` rows).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.isnull("doc_id").alias("no_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(rows, "rows")
    n = rows.count()
    blocks = max(1, -(-n // (shards * block_rows)))
    parts = shards * blocks
    dealt = stored(rows.repartition(parts).withColumn("part", F.spark_partition_id()), "parts")
    sizes = np.zeros(parts, np.int64)
    for part, m in dealt.groupBy("part").count().toLocalIterator():
        sizes[part] = m
    shard_sizes = split_evenly(n, shards)
    matrix = np.stack(list(fixed_margins(sizes, shard_sizes, np.random.default_rng([seed, 0]))))
    part, shard = (x.ravel() for x in np.indices(matrix.shape))
    cells = pd.DataFrame({"part": part, "group": part // GROUP_PARTS, "shard": shard, "n": matrix.ravel()})[(sizes > 0)[part]]
    counts = spark.createDataFrame(cells.astype("int64"), "part long, group long, shard long, n long")
    groups = counts.groupBy("shard").applyInPandas(_group_matrix(seed, blocks), "shard long, group long, counts array<long>")
    fine = counts.groupBy("shard", "group").cogroup(groups.groupBy("shard", "group")).applyInPandas(_block_matrix(seed), "part long, shard long, counts array<long>")
    by_part = dealt.withColumn("part", F.col("part").cast("long"))
    sent = by_part.groupBy("part").cogroup(fine.groupBy("part")).applyInPandas(
        _cut(seed, blocks), "doc_id long, no_id boolean, size long, text_crc32 long, block long"
    )
    total = F.lit(n // shards) + F.when(F.floor(F.col("block") / blocks) < n % shards, 1).otherwise(0)
    placed = sent.withColumn("shard_rows", total.cast("long")).groupBy("block").applyInPandas(
        _place(seed, blocks), "doc_id long, no_id boolean, size long, text_crc32 long, shard int, slot long"
    )
    return placed.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
