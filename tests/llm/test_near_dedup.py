import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import common
from noteloom.llm import near_dedup as nd

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, part=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    posts = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            posts[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in posts[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= part * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def result(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(df, **kw).collect()}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("few_pairs,family", [(2, 256), (1 << 20, 256), (1 << 20, 1)])
def test_families_with_chains_and_a_common_passage(spark, few_pairs, family):
    pick = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    passage = pick.choices(words, k=60)
    rows, n = [], 0
    for size in (40, 90, 200):
        base = pick.choices(words, k=size)
        for _ in range(12):
            copy = list(base)
            for _ in range(pick.randrange(4)):
                copy[pick.randrange(size)] = "edit%d" % pick.randrange(1000)
            rows.append((n, " ".join(copy)))
            n += 1
            base = copy if pick.random() < 0.3 else base
    for _ in range(30):
        rows.append((n, " ".join(pick.choices(words, k=pick.randrange(5, 60)) + passage)))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, few_pairs=few_pairs, family=family) == plain(rows)


@pytest.mark.parametrize("n", [400, 800])
def test_a_second_version_has_its_own_centre(spark, monkeypatch, n):
    """Two versions of a text, each with many copies that differ in a word: copies of a version are not compared in pairs."""
    pick, seen, write = random.Random(5), [], nd.stored

    def counted(df, name):
        out = write(df, name)
        seen.append((name, out.count() if name in ("pairs", "across") else 0))
        return out

    monkeypatch.setattr(nd, "stored", counted)
    base = [f"w{pick.randrange(5000)}" for _ in range(150)]
    other = base[:50] + [f"v{k}" for k in range(45)] + base[95:]
    rows = []
    for i in range(n):
        words = list(base if i % 5 < 3 else other)
        words[pick.randrange(150)] = f"e{pick.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {c for _, c in got.values()} == {0, 3} and got == plain(rows)
    assert "pairs" in dict(seen) and sum(x for _, x in seen) <= n


def test_who_is_near_a_large_family_visits_it_once(spark):
    """Five classes collide with each of 100 members of a family, but are not of it; two of them collide with each other."""
    row = lambda cls, fam, size, keys: [(k, cls, 50, fam, size, keys, at, 1) for at, k in enumerate(keys[:2])]
    rows = [x for cls in range(100) for x in row(cls, 0, 100, [7, 8, 9])]
    rows += [x for cls in range(200, 205) for x in row(cls, cls, 1, [8, 7, 9] if cls < 202 else [8, 7, 100 + cls])]
    lists = spark.createDataFrame(rows, "key long, cls long, n long, fam long, size long, keys array<long>, at int, depth int")
    pairs, visits = nd.cross_pairs(lists, 1 << 20, 3, (85, 100))
    assert [(r.a, r.b) for r in pairs.collect()] == [(200, 201)]
    assert sorted((r.fam, r.cls) for r in visits.collect()) == [(0, 200), (0, 201)]


def test_visitors_are_linked(spark):
    """Every family is visited, and texts of four lengths with a common passage collide across families."""
    pick = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    passage, rows = pick.choices(words, k=60), []
    for i in range(60):
        copy = passage + pick.choices(words, k=5 * (i % 4) + 1)
        for _ in range(pick.randrange(4)):
            copy[pick.randrange(60)] = "edit%d" % pick.randrange(1000)
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, visited=2, family=8) == plain(rows)


def direct(sets):
    """The components of sets of numbers, comparing all pairs."""
    up = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(set(x.tolist()) & set(sets[j].tolist()))
            if 100 * both >= 85 * (len(x) + len(sets[j]) - both):
                old, new = up[i], up[j]
                up = [new if u == old else u for u in up]
    return {frozenset(k for k, u in enumerate(up) if u == v) for v in up}


def linked(n, links):
    up = list(range(n))
    for a, b in links:
        old, new = up[a], up[b]
        up = [new if u == old else u for u in up]
    return {frozenset(k for k, u in enumerate(up) if u == v) for v in up}


@pytest.mark.parametrize("seed", range(12))
def test_links_within_a_family(spark, seed):
    """In a task and as rows: edits that many share, truncations, unrelated sets, all around the similarity."""
    rng = np.random.default_rng(seed)
    base, shared = rng.integers(1, 1 << 60, 80, np.uint64), rng.integers(1, 1 << 60, 12, np.uint64)
    sets = []
    for k in range(40):
        kept = base[: 80 - int(rng.integers(0, 15))] if rng.random() < 0.3 else rng.choice(base, 80 - int(rng.integers(0, 10)), False)
        more = np.concatenate([rng.choice(shared, int(rng.integers(0, 6)), False), rng.integers(1, 1 << 60, int(rng.integers(0, 6)), np.uint64)])
        sets.append(np.unique(rng.integers(1, 1 << 60, 50, np.uint64) if k % 13 == 12 else np.concatenate([kept, more])))
    assert linked(40, nd.family_links(list(range(40)), sets, (85, 100))) == direct(sets)
    if seed < 3:
        rows = [(0, k, s.tobytes()) for k, s in enumerate(sets)]
        df = spark.createDataFrame(rows, "fam long, cls long, members binary").repartition(3)
        assert linked(40, [(r.a, r.b) for r in nd.large_family_links(df, (85, 100)).collect()]) == direct(sets)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, " \t\n", 5), (3, "A b", 5), (4, "a B", 5), (5, "a b c d e", 5), (6, "a b c d é", 5), (None, "a b", 5), (None, "other", 5), (7, "x y z u v w", 5), (7, "x y z u v w", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(df).collect())
    want = [(None, 1, None, True), (None, 1, 3, False), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert got == Counter(want + [(5, 1, 5, True), (6, 1, 6, True), (7, 2, 7, True), (7, 2, 7, True)])
    assert sorted(nd.drop_near(df).columns) == sorted(df.columns)
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_components(spark):
    nodes = spark.range(40).withColumnRenamed("id", "cls")
    chain = spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.cls: r.comp for r in nd.components(nodes, chain).collect()}
    assert got == {k: 0 if k <= 30 else k for k in range(40)}


@pytest.mark.parametrize("most", [1000, 0])
def test_labels_in_a_task_and_in_rounds(spark, most):
    pick = random.Random(3)
    pairs = [(pick.randrange(300), pick.randrange(300)) for _ in range(140)] + [(400 + k, 401 + k) for k in range(20)] + [(500, k) for k in range(501, 520)] * 3
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r.cls: r.comp for r in nd.labelled(links, most).collect()}
    want = {min(x): x for x in linked(520, pairs) if len(x) > 1}
    assert got == {k: low for low, x in want.items() for k in x}


def test_nothing_that_grows_goes_through_the_driver(spark, monkeypatch):
    """Tables beyond MOST_SENT are not broadcast by Spark's own choice either: it goes by the bytes of packed files."""
    monkeypatch.setattr(common, "MOST_SENT", -1, raising=False)
    plans, write = [], nd.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(nd, "stored", noted)
    pick, rows = random.Random(6), []
    for i in range(60):
        words = [f"w{i % 3}x{k}" for k in range(80)]
        for _ in range(i % 9):
            words[pick.randrange(80)] = f"e{pick.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), family=4)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == plain(rows)
    assert {"families", "visits", "differences", "posts", "pairs", "wanted", "out"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_few_numbers_are_sent(spark):
    df = spark.createDataFrame([(1, [1] * 50), (2, [2] * 50)], "a long, b array<long>")
    plan = lambda side: df.select("a").join(side, "a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(common.sent(df, F.size("b"), 104)) and "SortMergeJoin" in plan(common.sent(df, F.size("b"), 103))
    assert "ShuffledHashJoin" in plan(common.spread_by_hash(df)) and "SortMergeJoin" in plan(common.spread(df))


def test_ids_that_stay_are_not_sent(spark, monkeypatch):
    """The pipeline's stage joins texts with the ids that stay, most of all: by a shuffle."""
    monkeypatch.setattr(common, "MOST_SENT", -1, raising=False)
    out = nd.drop_near(spark.createDataFrame([(k, f"a b c d e{k % 3}", "x") for k in range(9)], "doc_id long, text string, lang string"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2]
