"""Packed texts, stream arrivals with late rows, medians by ranges, sections, glossary and clips against plain versions."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from noteloom.operators import alignment as al
from noteloom.operators import metrics as mt
from noteloom.operators import transcript as tr
from noteloom.plans.fixtures import fixture
from noteloom.sources import readers, writers
from noteloom.streaming import streams

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 60, 10_000_000])
def test_packs_give_back_their_texts(spark, tmp_path, size):
    texts = ["", None, "one\ntwo\n", "ünï 😀", "x" * 5000, '{"a": "b\\"c"}', "  spaces  ", "\r\n", None, "last"]
    rows = [(k // 2, f"c{k % 2} \"q\"", t) for k, t in enumerate(texts)]
    writers.pack_write(spark.createDataFrame(rows, "source_id long, candidate string, text string"), ["source_id", "candidate"], "text", str(tmp_path / "p"), size)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path / "p")).count()
    assert files == (1 if size > 10_000 else files) and files > (3 if size == 1 else 0)
    got = readers.pack_scan(spark, str(tmp_path / "p"), "source_id long, candidate string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    writers.pack_write(spark.createDataFrame([(k, f"s{k}") for k in range(5)], "source_id long, text string"), ["source_id"], "text", str(tmp_path / "s"), size)
    pairs = readers.packed_pair_scan(spark, str(tmp_path / "s"), str(tmp_path / "p")).collect()
    assert len(pairs) == len(rows) and all(r.source_text == f"s{r.source_id}" for r in pairs)


def calls_at(spark, path, rows):
    df = spark.createDataFrame([(k, 1, t) for k, t in rows], "call_id int, key_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.mode("append").parquet(path)
    return df.schema


def test_late_rows_are_counted(spark, tmp_path):
    """Two of the second arrival are older than the watermark; of the third, one is late but its window is still open."""
    path = str(tmp_path / "in")
    arrivals = [
        [(k, f"2031-05-06 07:{k:02}:30") for k in range(20)],
        [(20, "2031-05-06 07:01:10"), (21, "2031-05-06 07:02:00"), (22, "2031-05-06 07:30:00")],
        [(23, "2031-05-06 07:28:30"), (24, "2031-05-06 09:00:00")],
    ]

    def arriving():
        for rows in arrivals:
            calls_at(spark, path, rows)
            yield

    schema = "call_id int, key_id int, ts timestamp"
    counts = streams.Counts()
    make = lambda: streams.call_rate_stream(streams.seen(spark.readStream.schema(schema).parquet(path)))
    out = streams.run_arrivals(make, arriving(), "append", str(tmp_path / "run"), counts=counts)
    assert counts.seen == 25 and counts.dropped == 2
    open_windows = 1  # that of 09:00
    assert streams.late_rows(counts, out, "n_calls") == 2 + open_windows
    assert {str(r.window_start)[11:16] for r in out.collect()} == {f"07:{k:02}" for k in range(20)} | {"07:28", "07:30"}


@pytest.mark.parametrize("parts", [None, 6])
def test_medians_by_ranges(spark, parts):
    pick = random.Random(4)
    rows = [(k, pick.choice(["a", "a", "a", "b", None]), pick.choice([1.5, 2.5, pick.random()]), pick.random() if k else None) for k in range(301)]
    df = spark.createDataFrame(rows, "source_id int, candidate string, fidelity_score double, readability_score double")
    got = {(r.candidate, r.n): r for r in mt.quality_by_candidate(df, parts).collect()}
    for name in ("a", "b", None, "all"):
        own = [r for r in rows if name == "all" or r[1] == name]
        r = got[None if name == "all" else name, len(own)]
        for at, c in ((2, "fidelity_score"), (3, "readability_score")):
            v = [x[at] for x in own if x[at] is not None]
            assert abs(r[f"p50_{c}"] - statistics.median(v)) < 1e-12 and r[f"least_{c}"] == min(v) and abs(r[f"mean_{c}"] - statistics.fmean(v)) < 1e-9
    assert len(got) == 4
    assert mt.exact_median(df.filter("source_id < 0"), ["candidate"], "fidelity_score").count() == 0


def test_lexical_sections(spark):
    captions = fixture(spark, DATA, "fx_captions")
    sections, cues = defaultdict(list), defaultdict(list)
    for r in tr.split_lexical(captions).collect():
        sections[r.lecture_id].append((r.section_no, r.start_s, r.end_s))
    for r in captions.collect():
        cues[r.lecture_id].append((r.caption_no, r.start_s, r.end_s))
    begins = defaultdict(set)
    for r in tr.topic_boundaries(captions).filter("boundary").collect():
        begins[r.lecture_id].add(r.block_no * 4 + 1)
    assert sections.keys() == cues.keys()
    for k, own in cues.items():
        want, topic = [], None
        for no, start, end in sorted(own):
            if topic is None or no in begins[k]:
                topic, part = start, -1
            if part != (start - topic) // 300:
                part = (start - topic) // 300
                want.append([start, end])
            want[-1][1] = end
        assert sorted(sections[k]) == [(n, a, min(b, a + 300)) for n, (a, b) in enumerate(want)]
        assert all(b - a <= 300 for _, a, b in sections[k])
    assert tr.split_lexical(captions.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_glossary_against_all_terms(spark):
    pick = random.Random(2)
    word = lambda n: "".join(pick.choices("abé", k=n))
    words = sorted({word(pick.randrange(1, 8)) for _ in range(250)} | {"a", "ab", "z" * 400, "naïve"})
    terms = sorted({word(pick.randrange(1, 7)) for _ in range(40)} | {"naive", "zz"})
    rows = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.word: r.fixed for r in tr.glossary_fix(*rows).collect()}
    for w in words:
        near = sorted((d, t) for t in terms if t[0] == w[0] and (d := edits(w, t)) <= 2)
        best = [t for d, t in near if d == near[0][0]]
        assert got[w] == (w if not near else best[0] if len(best) == 1 else f"[?: {w}]")
    assert tr.glossary_fix(rows[0], rows[1].limit(0)).filter("word <> fixed").count() == 0


def test_runs_meet_only_gaps_that_they_may_cut(spark):
    """A pair of 20,000 words with a change at every tenth: 2000 gaps and 4000 runs would be 8,000,000 rows by the pair alone."""
    gaps = spark.createDataFrame([(1, "c", k * 10, k * 10 + 9, k * 10, k * 10 + 9) for k in range(2000)], "source_id long, candidate string, alo int, ahi int, blo int, bhi int")
    pick = random.Random(6)
    runs = [(1, "c", k * 10 + pick.randrange(-3, 9), k * 10, pick.choice([2, 3, 30])) for k in range(1, 2000) for _ in range(2)]
    met = al.meeting(gaps, spark.createDataFrame(runs, "source_id long, candidate string, i0 int, j0 int, n int"))
    got = sorted((r.alo, r.i0, r.j0, r.n) for r in met.collect())
    want = sorted((k * 10, i, j, n) for _, _, i, j, n in runs for k in range(2000) if k * 10 < i + n and i < k * 10 + 9)
    assert got == want and len(got) < 4 * (2000 + len(runs))
