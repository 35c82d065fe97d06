"""Queries on text pairs move the documents once and nothing else: their n-grams and tokens are counted where the texts are."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.operators import alignment as al
from noteloom.operators import metrics as mt
from noteloom.plans import fixtures
from noteloom.plans import queries as plans
from noteloom.sources.shared import settled

DATA = "/root/testdata/sf0.001"
SCHEMA = "source_id long, candidate string, cand_ord int, source_text string, candidate_text string"


@pytest.mark.parametrize("name", ["gram_overlap_join", "rouge", "ngram_counts", "gram_intersect_all", "token_match_join", "vocab_union", "vocab_shared", "vocab_novel", "vocab_metrics", "sentence_shared", "sentence_overlap", "readability", "pair_stats"])
def test_documents_move_once(spark, name, monkeypatch):
    monkeypatch.setattr(fixtures, "PART_BYTES", 50_000)
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange (\w+\(?\w+)", plan) == ["hashpartitioning(doc_id"], plan


def test_counts_against_plain_ones(spark):
    texts = [("the cat. The the cat sat", "the the the cat the cat"), ("", "a b"), (None, "a"), ("a a a a", "a a"), ("x", None), ("one two", "three")]
    df = mt.token_pairs(spark.createDataFrame([(k, "c", 0, a, b) for k, (a, b) in enumerate(texts)], SCHEMA))
    words = {k: [re.findall("[a-z]+", (t or "").lower()) for t in pair] for k, pair in enumerate(texts)}
    for n in (1, 2, 3):
        bags = {k: [Counter(zip(*(t[i:] for i in range(n)))) for t in w] for k, w in words.items()}
        want = {k: sum((a & b).values()) for k, (a, b) in bags.items() if a & b}
        assert {r.source_id: r.overlap for r in mt.gram_overlap_join(df, n).collect()} == want == {r.source_id: r.overlap for r in mt.gram_intersect_all(df, n).collect()}
        assert {(r.source_id, r.gram): r.cnt for r in mt.ngram_counts(df, n, "ct").collect()} == {(k, " ".join(g)): c for k, (_, b) in bags.items() for g, c in b.items()}
    assert {r.source_id for r in mt.rouge(df).collect()} == set(words)
    met = {k: [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y] for k, (a, b) in words.items()}
    sums = {r.source_id: (r.n, r.sum_i, r.sum_j) for r in al.token_match_sums(df).collect()}
    assert sums == {k: (len(m), sum(i for i, _ in m), sum(j for _, j in m)) for k, m in met.items() if m}


def test_sentences_of_odd_texts(spark):
    texts = ["One,  two!  ÄÖ three?\n\tfour--five. ", "...", "a. A. b", "Йод. ёж! x y", "", "1.5 is. not cut"]
    plain = lambda x: re.sub(" +", " ", re.sub("[^A-Za-zА-Яа-яЁё0-9 ]+", " ", x.lower())).strip()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", s.sentences(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == list(dict.fromkeys(y for y in map(plain, re.split(r"(?<=[.!?])\s+", r.t)) if y))


def test_runs_of_regions_against_all_pairs_of_places(monkeypatch):
    """Few matches at a time, as for texts of repeated lines, give the same maximal runs."""
    monkeypatch.setattr(al, "MATCHES", 7)
    pick = random.Random(5)
    for n in (1, 2, 3, 5, 6):
        a, b = ([pick.randrange(3) for _ in range(60)] for _ in range(2))
        regions = [(0, 20, 0, 15), (21, 40, 15, 33), (44, 44, 35, 36), (50, 60, 40, 60)]
        want = set()
        for r, (alo, ahi, blo, bhi) in enumerate(regions):
            for i in range(alo, ahi):
                for j in range(blo, bhi):
                    if a[i] == b[j] and (i == alo or j == blo or a[i - 1] != b[j - 1]):
                        size = next(k for k in range(61) if i + k == ahi or j + k == bhi or a[i + k] != b[j + k])
                        want |= {(r, i, j, size)} if size >= n else set()
        lo_hi = [np.array(x) for x in zip(*regions, strict=True)]
        r, i, j, size = al._region_runs(np.array(a + b), lo_hi[0], lo_hi[1], lo_hi[2] + 60, lo_hi[3] + 60, n)
        assert sorted(zip(r.tolist(), i.tolist(), (j - 60).tolist(), size.tolist(), strict=True)) == sorted(want)


def test_alignment_stores_no_grams(spark, monkeypatch):
    """Pairs begun by each other are one block; of others only numbered tokens, runs and regions are stored, none with a text."""
    stored = {}
    monkeypatch.setattr(al, "settled", lambda df, name: stored.setdefault(name, []).append(df.schema) or settled(df, name))
    rows = [(1, "c", 0, "a b c", "a b"), (2, "c", 0, "a b c d", "c d a b"), (3, "c", 0, "", "a"), (4, "c", 0, "a", "a")]
    got = sorted(tuple(r) for r in al.word_alignment(mt.token_pairs(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == [(1, "c", 0, 0, 2), (2, "c", 0, 2, 2), (4, "c", 0, 0, 1)]
    texts = [f.name for schemas in stored.values() for schema in schemas for f in schema if "string" in f.dataType.simpleString()]
    assert "numbers" in stored and set(texts) == {"candidate"}


def test_sums_are_over_the_matches(spark, monkeypatch):
    """The sums are those of the rows that token_match_join() makes, one for each two equal tokens of a pair."""
    texts = [("a b a", "a a c a"), ("a " * 300, "a " * 200), ("a", "b"), ("", "a"), (None, None)]
    df = mt.token_pairs(spark.createDataFrame([(k, "c", 0, a, b) for k, (a, b) in enumerate(texts)], SCHEMA))
    want = [(k, i, j) for k, (a, b) in enumerate(texts) for i, x in enumerate((a or "").split()) for j, y in enumerate((b or "").split()) if x == y]
    join, seen = al.token_match_join, []
    monkeypatch.setattr(al, "token_match_join", lambda pairs: seen.append(join(pairs)) or seen[-1])
    sums = {r.source_id: (r.n, r.sum_i, r.sum_j) for r in al.token_match_sums(df).collect()}
    assert sorted((r.source_id, r.i, r.j) for r in seen[0].collect()) == want
    assert sums == {k: tuple(sum(x) for x in zip(*((1, i, j) for key, i, j in want if key == k), strict=True)) for k in (0, 1)}


def test_overlaps_write_out_no_grams(spark, monkeypatch):
    """rouge and gram_overlap_join count n-grams by number where the pair is: no n-gram is a row or a text."""
    from noteloom.operators import numbering

    monkeypatch.setattr(numbering, "SLICE", 7)  # several slices of a batch
    pick = random.Random(8)
    texts = [(" ".join(pick.choices("abcd", k=pick.randrange(9))), " ".join(pick.choices("abcd", k=pick.randrange(9)))) for _ in range(40)] + [(None, "a b"), ("a b", None)]
    df = mt.token_pairs(spark.createDataFrame([(k, "c", 0, a, b) for k, (a, b) in enumerate(texts)], SCHEMA))
    bags = lambda t, n: Counter(zip(*((t or "").split()[i:] for i in range(n))))
    for n in (1, 2, 3, 4):
        want = {k: sum((bags(a, n) & bags(b, n)).values()) for k, (a, b) in enumerate(texts)}
        assert {r.source_id: r.overlap for r in mt.gram_overlap_join(df, n).collect()} == {k: x for k, x in want.items() if x}
    got = {r.source_id: r for r in mt.rouge(df).collect()}
    for k, (a, b) in enumerate(texts):
        for n in (1, 2):
            both, one, two = (bags(a, n) & bags(b, n)).total(), bags(a, n).total(), bags(b, n).total()
            assert got[k][f"rouge{n}_recall"] == (both / one if one else 0) and got[k][f"rouge{n}_precision"] == (both / two if two else 0)
    for out in (mt.rouge(df), mt.gram_overlap_join(df, 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan
