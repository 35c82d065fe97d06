"""Numbering, neighbours and sweeps by range partitions, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import events as ev
from noteloom.operators import ranges


def rows_of(seed, n=400):
    pick = random.Random(seed)
    return [(k, pick.choice([1, 1, 1, 1, 2, 3]), f"2031-05-06 0{pick.randrange(3)}:{pick.randrange(60):02}:{pick.randrange(60):02}") for k in range(n)]


def calls_of(spark, rows):
    return spark.createDataFrame(rows, "call_id int, key_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("parts", [None, 1, 7, 50])
def test_numbers_and_neighbours(spark, parts):
    rows = rows_of(parts or 0)
    calls = calls_of(spark, rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    got = ranges.numbered(calls, ["key_id"], ["ts", "call_id"], parts).collect()
    assert {(r.key_id, r.rn): (r.call_id, r.total) for r in got} == {(k, n): (r[0], len(own)) for k, own in by.items() for n, r in enumerate(own, 1)}
    seconds = lambda t: int(t[11:13]) * 3600 + int(t[14:16]) * 60 + int(t[17:])
    want = {r[0]: None if n == 0 else float(seconds(r[2]) - seconds(own[n - 1][2])) for own in by.values() for n, r in enumerate(own)}
    assert {r.call_id: r.gap_s for r in ev.call_spacing(calls, parts=parts).collect()} == want
    dealt = ev.round_robin(calls.select(F.col("call_id").alias("prompt_id"), "key_id"), 5, "key_id", parts).collect()
    order = {k: sorted(r[0] for r in own) for k, own in by.items()}
    assert all(r.dealt_key == order[r.key_id].index(r.prompt_id) % 5 for r in dealt) and len(dealt) == len(rows)
    assert {r.transcribe_pct for r in ev.fanout_progress(calls, parts).collect()} == {20 + (n + 1) * 70 // len(own) for own in by.values() for n in range(len(own))}


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_sweep_over_blocks(spark, parts):
    rows = rows_of(3)
    calls = calls_of(spark, rows)
    blocks = ev.block_intervals(calls.filter("call_id % 3 = 0").select("key_id", "ts")).cache()
    spans = [(r.key_id, str(r.block_start), str(r.block_end)) for r in blocks.collect()]
    want = {r[0]: {k for k, a, b in spans if a <= r[2] < b} for r in rows}
    assert {r.call_id: r.alive for r in ev.alive_keys(calls, blocks, 6, parts).collect()} == {k: 6 - len(v) for k, v in want.items()}
    got = ev.blocked_at(calls, blocks, parts).collect()
    assert sorted((r.call_id, r.blocked_key) for r in got) == sorted((k, x) for k, v in want.items() for x in v)
    assert any(len(v) > 1 for v in want.values()) and any(not v for v in want.values())


def test_no_rows(spark):
    calls = calls_of(spark, [(1, 1, "2031-05-06 00:00:00")]).filter(F.lit(False))
    blocks = ev.block_intervals(calls.select("key_id", "ts"))
    assert ev.alive_keys(calls, blocks, 3).count() == ev.blocked_at(calls, blocks).count() == ev.call_spacing(calls).count() == 0
