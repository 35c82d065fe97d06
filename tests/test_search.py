"""The block-bounded search against scores of all documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteloom.operators import search as sr
from noteloom.operators import sections as se


def plain(docs, queries, k):
    bags = {i: Counter(t.split()) for i, t in docs}
    df = Counter(t for bag in bags.values() for t in bag)
    out = {}
    for q, text in queries:
        scores = {}
        for i, bag in bags.items():
            if own := [t for t in set(text.split()) if t in bag]:
                scores[i] = round(sum(bag[t] * math.log(len(docs) / df[t]) for t in own), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, n): x for n, x in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("block", "k", "most"), [(5, 3, 200_000), (40, 10, 0), (10_000, 10, 200_000)])
def test_best_documents(spark, monkeypatch, block, k, most):
    """Small and large blocks, with and without broadcasts."""
    monkeypatch.setattr(sr, "SENT_ROWS", most)
    pick = random.Random(block)
    words = [f"w{x}" for x in range(60)]
    docs = [(7 * n, " ".join(["all", *pick.choices(words, weights=[1 / (x + 1) for x in range(60)], k=pick.choice([3, 8, 40, 150]))])) for n in range(300)] + [(5000, "all rare rare"), (5001, "all")]
    queries = [(1, "w0 w1 w2 all"), (2, "w55 w56 w57"), (3, "rare all"), (4, "all"), (5, "nothing here"), (6, " ".join(words)), (7, "rare")]
    known = sr.index(spark.createDataFrame(docs, "doc_id long, text string"), block)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in sr.search(known, asked, k).collect()}
    want = plain(docs, queries, k)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_blocks_that_cannot_win_are_not_read(spark):
    """"often" is in all documents but one; the other blocks of short documents have no chance against the long ones."""
    docs = [(n, "often a b" if n else "a") for n in range(600)] + [(1000 + n, "often " * (24 + n % 2) + "c") for n in range(20)]
    known = sr.index(spark.createDataFrame(docs, "doc_id long, text string"), 20)
    asked = spark.createDataFrame([(1, "often")], "item_id long, token string").join(known.terms, "token")
    _, rest = sr.promising(known, asked, 10)
    assert known.maxima.filter("token = 'often'").count() > 25 and rest.count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert sr.search(sr.index(none), asked).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in sr.search(sr.index(some), asked).select("item_id", "doc_id", "rank").collect()] == [(1, 1, 1)]
    assert sr.search(sr.index(some), asked.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("list_rows", [3, 100_000])
def test_slides_by_all_terms(spark, list_rows):
    """Against the cosines of all pairs. A term of 20 % of the sections is late in those that have rarer ones, so it makes few pairs."""
    pick = random.Random(9)
    words = [f"w{x}" for x in range(120)]
    texts = lambda n, most: [(k, " ".join([*(["often"] if k % 6 == 0 else []), *pick.choices(words, weights=[1 / (x + 2) for x in range(120)], k=pick.randrange(0, most))])) for k in range(n)]
    rows, deck = texts(200, 60), texts(30, 20)
    rows += [(1000 + k, f"u{k} " * 40 + "often") for k in range(5)]
    bags, decks = ({k: Counter(t.split()) for k, t in x} for x in (rows, deck))
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log(len(rows) / n) for t, n in df.items() if n <= 0.2 * len(rows)}
    vector = lambda b: {t: n * idf[t] for t, n in b.items() if t in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, a in ((k, vector(b)) for k, b in bags.items()):
        sims = []
        for m, b in ((m, vector(b)) for m, b in decks.items()):
            if a.keys() & b.keys() and (sim := round(sum(a[t] * b[t] for t in a.keys() & b.keys()) / norm(a) / norm(b), 6)) >= 0.05:
                sims.append((-sim, m))
        want |= {(k, n): (m, -sim) for n, (sim, m) in enumerate(sorted(sims)[:3], 1)}
    tables = spark.createDataFrame(rows, "section_id int, text string"), spark.createDataFrame(deck, "slide_id int, text string")
    got = {(r.section_id, r["rank"]): (r.slide_id, r.sim) for r in se.slide_match_text(*tables, list_rows=list_rows).collect()}
    assert got == want
    left, right = se.weighted_terms(*tables)
    late = left.filter("late")
    assert "often" in idf and df["often"] > 0.18 * len(rows) and late.filter("section_id >= 1000 AND term = 'often'").count() == 5
    every = left.select("section_id", "term").join(right, "term").count()
    assert se.term_pairs(left, right, list_rows).count() == every - late.select("term").join(right, "term").count()


def test_more_texts_are_more_partitions(spark, monkeypatch):
    """The postings of a task are those of PART_CHARS of texts or so, however many texts there are."""
    monkeypatch.setattr(sr, "PART_CHARS", 500)
    for n in (20, 80):
        docs = spark.createDataFrame([(k, f"w{k} " * 24 + "x") for k in range(10, 10 + n)], "doc_id long, text string")
        known = sr.index(docs, block_docs=4)
        assert known.parts == -(-n * 97 // 500)
        assert len(known.postings.inputFiles()) > n / 20
