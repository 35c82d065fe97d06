from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noteloom.llm import exact_dedup as ed
from noteloom.llm import sharding as sh

SCHEMA = "doc_id long, text string, key string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Ab É", "k"), (2, "aB É", None), (3, "ab é", "k"), (4, None, ""), (5, "", ""), (None, "AB É", ""), (7, "x" * 100_000, ""), (7, "x" * 100_000, "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("capacity", [1, 2, 8192])
def test_groups(odd, capacity):
    rows = [(r.doc_id, (r.text or "").translate(UPPER)) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter((i, max(x for x in groups[t] if x is not None), len(groups[t]), sha256(t.encode()).hexdigest()) for i, t in rows)
    got = ed.exact_dedup(odd, capacity=capacity).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_no_bucket_is_overfull_and_slots_cover_the_directory(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    index, slots, depth = ed.build_index(ed.keyed(docs), capacity=64)
    assert index.count() == 3000
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 64
    held = sorted(r.slot for r in slots.collect())
    assert held == list(range(2**depth)) or len(set(held)) == len(held) <= 2**depth


def test_colliding_keys_are_chained_and_told_apart_by_their_bytes(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "a", 5), (4, "c", 6), (5, "b", 5)], "doc_id long, text string, key long")
    index, slots, depth = ed.build_index(rows)
    assert sorted((r.key, r.chain, r.length) for r in index.collect()) == [(5, 1, 2), (5, 2, 2), (6, 1, 1)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ed.probe(rows, index, slots, depth).collect()}
    assert got == {1: (3, 2), 2: (5, 2), 3: (3, 2), 4: (4, 1), 5: (5, 2)}


def test_rows_are_found_through_the_directory_only(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    rows = ed.keyed(docs)
    index, slots, depth = ed.build_index(rows, capacity=16)
    assert depth > 0 and ed.probe(rows, index, slots, depth).count() == 500
    some = slots.filter("slot % 2 = 0")
    kept = rows.withColumn("slot", ed._prefix(depth)).join(some, "slot").count()
    assert 0 < kept < 500 and ed.probe(rows, index, some, depth).count() == kept
    turned = slots.withColumn("bucket", F.col("bucket") + 1)
    assert ed.probe(rows, index, turned, depth).count() < 500


def test_empty_tables(spark, odd):
    assert ed.exact_dedup(odd.limit(0)).count() == 0
    assert sh.shard_rows(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [5, 4096])
def test_shards_are_even_gapless_and_complete(spark, block_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sh.shard_rows(docs, block_rows=block_rows).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in sh.shard_rows(docs, block_rows=block_rows).collect()}
    assert len(again) == len(got)


def test_sharding_of_nulls_and_repeats(odd):
    got = sh.shard_rows(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert len({(r.shard, r.slot) for r in got}) == 8


def test_places_are_uniform():
    rng = np.random.default_rng(3)
    seen = np.zeros((3, 4))
    for _ in range(4000):
        seen += list(sh.fixed_margins(np.array([2, 4, 6]), np.array([3, 3, 3, 3]), rng))
    assert np.abs(seen / 4000 - np.array([[2], [4], [6]]) * 3 / 12).max() < 0.06


def chi_square(seen, want, n):
    assert set(seen) <= set(want)
    return sum((seen.get(k, 0) - p * n) ** 2 / (p * n) for k, p in want.items())


def joint_law(rows, cols):
    """The probability of each matrix, by dealing all orders of the columns' places to the rows."""
    places = [c for c, k in enumerate(cols) for _ in range(k)]
    seen = Counter()
    for order in set(permutations(places)):
        ends = np.cumsum([0, *rows])
        seen[tuple(tuple(order[x:y].count(c) for c in range(len(cols))) for x, y in zip(ends, ends[1:], strict=False))] += 1
    return {k: v / sum(seen.values()) for k, v in seen.items()}


def test_joint_law_of_the_matrix():
    want, rng, n = joint_law((2, 1, 3), (3, 3)), np.random.default_rng(8), 6000
    seen = Counter(tuple(tuple(x.tolist()) for x in sh.fixed_margins(np.array([2, 1, 3]), np.array([3, 3]), rng)) for _ in range(n))
    assert chi_square(seen, want, n) < 30  # 8 matrices at most: beyond 1 in 10,000


def test_joint_law_through_groups_of_parts():
    want, n, seen = joint_law((2, 1, 1, 2), (3, 3)), 4000, Counter()
    parts = pd.DataFrame({"part": range(4), "group": [0, 0, 1, 1], "shard": 0, "n": [2, 1, 1, 2]})
    for seed in range(n):
        groups = sh._group_matrix(seed, 2)(parts)
        rows = [sh._block_matrix(seed)(parts[parts.group == g], groups[groups.group == g]) for g in (0, 1)]
        seen[tuple(tuple(x) for x in pd.concat(rows).sort_values("part")["counts"])] += 1
    assert chi_square(seen, want, n) < 45


def test_equal_results_after_a_rerun_of_the_tasks(spark, monkeypatch):
    """Blocks, groups and slots come from seeds and sorted rows alone, so a task that runs again gives the same."""
    monkeypatch.setattr(sh, "GROUP_PARTS", 3)
    placed = sh.shard_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), block_rows=4)
    first, again = ({(r.doc_id, r.shard, r.slot) for r in placed.collect()} for _ in range(2))
    assert first == again and len(first) > 100


def test_ties_are_placed_one_by_one(spark):
    rows = spark.createDataFrame([(1, "same", 0, 0)] * 40, "doc_id long, text string, shard int, slot int")
    got = sh.shard_rows(rows, block_rows=2).collect()
    assert len({(r.shard, r.slot) for r in got}) == 40 and {r["size"] for r in got} == {5}
