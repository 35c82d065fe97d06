import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from noteloom.llm import suffix_tree as st


def cut(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def check_base(rows, got):
    train = Counter(t for i, x in rows if i is None or crc32(str(i).encode()) % 10 for t in cut(x))
    n, v = sum(train.values()), len(train)
    by = {}
    for i, x in rows:
        ts = cut(x)
        by[i] = (len(ts), sum(t in train for t in ts), sum(log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*by[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(by[r.doc_id][2], rel=1e-9)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 10 == 0)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = st.lm_scores(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_distributions_sum_to_one():
    rng = np.random.default_rng(4)
    m = 12
    step = rng.dirichlet(np.full(m, 0.2), (m, m))
    x = [0, 0]
    for _ in range(60_000):
        x.append(rng.choice(m, p=step[x[-2], x[-1]]))
    x = np.array(x)
    c2, n2 = np.unique(x[:-1] * m + x[1:], return_counts=True)
    c3, n3 = np.unique((x[:-2] * m + x[1:-1] + m) * m + x[2:], return_counts=True)
    counts = np.bincount(x, minlength=m).astype(float)
    root = np.log10(counts / counts.sum())
    tree = st.build_tree(np.concatenate([c2, c3]), np.concatenate([n2, n3]).astype(float), counts, root)
    assert len(tree["s2"]) > 50
    off = []
    for a in range(m):
        for b in range(m):
            p = [10 ** st.score(tree, np.array([a, b, c]), root[[a, b, c]], 0)[2] for c in range(m)]
            assert sum(p) == pytest.approx(1, abs=1e-6)
            off.append(np.abs(np.array(p) - step[a, b]).mean())
    assert np.mean(off) < 0.03


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A\tb\nA é É"), (None, "a b"), (5, "x " * 30_000), (10, "zz"), (11, "zz")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    check_base(rows, st.lm_scores(docs).collect())
    twice = st.lm_scores(docs.union(docs)).collect()
    assert len(twice) == 14 and len({(r.doc_id, r.score) for r in twice}) == 7
    assert st.lm_scores(docs.limit(0)).count() == 0


def test_rare_contexts_are_in_the_tree(spark):
    """A context far below a ten-thousandth of the tokens is retained, and scores are those of the tree made on one machine."""
    pick = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{x}" for x in pick.zipf(1.3, 300) % 5000)) for k in range(400)]
    rows += [(k, f"{'f ' * 20}rare{k % 9} pair{k % 9} next{k % 9} last{k % 9}") for k in range(400, 480)]
    train = [cut(x) for i, x in rows if crc32(str(i).encode()) % 10]
    c = Counter(t for ts in train for t in ts)
    total = sum(c.values())
    assert all(c[f"rare{k}"] < 1e-4 * total for k in range(9))
    words = sorted({t for _, x in rows for t in cut(x)})
    of, m = {w: k for k, w in enumerate(words)}, len(words)
    grams = Counter()
    for ts in train:
        y = [of[t] for t in ["\n", *ts]]
        grams.update(a * m + b for a, b in zip(y, y[1:]))
        grams.update((a * m + b + m) * m + d for a, b, d in zip(y, y[1:], y[2:]))
    codes = np.array(sorted(k for k, n in grams.items() if n >= 3))
    counts = np.array([c[w] for w in words], float)
    root = np.log10(counts + 0.1) - log10(total + 0.1 * (len(c) + 1))
    tree = st.build_tree(codes, np.array([grams[k] for k in codes], float), counts, root)
    got = {r.doc_id: r for r in st.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, x in rows:
        y = np.array([of[t] for t in cut(x)])
        assert got[i].score == pytest.approx(st.score(tree, y, root[y], of["\n"]).sum(), rel=1e-9)
    assert all(got[i].score > got[i].base_score + 6 for i, _ in rows[400:])


def test_a_block_dictionary_is_one_row(spark):
    """Ids and counts of a block's words are packed by place; only words with an id become rows again."""
    rows = [(b, p, 2**33 + p, (b * 7 + p * 5) % 4) for b in (3, 1 << 24) for p in (4, 0, 2, 1, 3)]
    df = spark.createDataFrame(rows, "block long, place long, c long, id long")
    got = df.groupBy("block").applyInPandas(st._valued, st.VALUED)
    assert got.count() == 2
    for r in got.collect():
        own = sorted(x[1:] for x in rows if x[0] == r.block)
        assert st._unpack(bytes(r.ids), 1)[0].tolist() == [x[2] for x in own]
        assert np.frombuffer(st.zstandard.decompress(bytes(r.counts)), np.int64).tolist() == [x[1] for x in own]
    frequent = got.select("block", "ids").mapInArrow(st._frequent, "block long, place long, id long").collect()
    assert sorted(map(tuple, frequent)) == sorted((b, p, i) for b, p, _, i in rows if i)


def test_texts_are_scored_together_as_one_by_one():
    """Texts of one, two and more tokens that follow one another, with symbols that are unknown."""
    rng = np.random.default_rng(5)
    m, end = 30, 0
    root = np.log10(rng.dirichlet(np.ones(m)))
    codes = np.unique(np.concatenate([rng.integers(0, m * m, 200), m * m + rng.integers(0, m**3, 3000)]))
    counts = rng.integers(200, 300, m)
    tree = st.build_tree(codes, rng.integers(3, 60, len(codes)).astype(float), counts.astype(float), root)
    assert len(tree["s1"]) and len(tree["s2"])
    texts = [np.append(rng.integers(-1, m, k), end) for k in (0, 1, 2, 0, 40, 0, 300)]
    flat, begins = np.concatenate(texts), np.cumsum([0] + [len(x) for x in texts[:-1]])
    each = [st.score(tree, x, root[x], end) for x in texts]
    assert np.array_equal(st.score_all(tree, flat, root[flat], end, begins), np.concatenate(each))
