import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from noteloom.llm import suffix_dedup as sd


def plain(rows):
    """By a set of all windows, in order of doc_id."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        gone = gone[:-1]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, x in zip(data, gone, strict=True) if not x)
        out.append((doc_id, len(data), int(gone.sum()), spans, sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in sd.passage_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block_bytes", [3000, 8_000_000])
def test_edited_copies_and_periodic_texts(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block_bytes)
    pick = random.Random(8)
    base = "".join(pick.choices("abcdefg é\n", k=1500))
    rows = [(k, base[:a] + "".join(pick.choices("xyz", k=pick.randrange(4))) + base[a + pick.randrange(3) :]) for k in range(25) for a in [pick.randrange(1500)]]
    rows += [(100 + k, "ab" * pick.randrange(40, 200) + base[k * 7 : k * 7 + 98 + k]) for k in range(12)]
    rows += [(200, "\0" * 300), (201, "\0" * 99 + "\1"), (202, "\0" * 100), (203, "x"), (204, None), (205, ""), (206, "q" * 100), (207, "q" * 100), (None, base), (-5, base[3:400])]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, block string")
    assert got(df) == plain(rows)


def test_long_text_over_segments(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 500)
    pick = random.Random(9)
    base = "".join(pick.choices("abcdefghij", k=4000))
    rows = [(1, base + base[1000:3000] + "tail"), (2, "head" + base[200:2500]), (3, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "w" * 50 + "v" * 80), (1, "w" * 50 + "v" * 80), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.passage_dedup(df).collect()) == [0, 0, 130]
    assert sd.passage_dedup(df.limit(0)).count() == 0


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 4000, 5000).astype("S6")
    family, seen = sd.Family(), []
    for k in range(0, 5000, 100):
        seen += family.add(data[k : k + 100]).tolist()
    first = np.unique(data, return_index=True)[1]
    assert set(np.flatnonzero(~np.array(seen))) == set(first)
    sizes = [len(x) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(first)
