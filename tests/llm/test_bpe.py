import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from noteloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    return bpe.Vocabulary(path), Tokenizer.from_file(path)


def test_every_code_point_is_cut_as_the_library_cuts_it(both):
    ours, theirs = both
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    texts = [f"a{chr(c)} {chr(c)}1!{chr(c)}x  {chr(c)}{chr(c)}" for c in points]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        assert ours.encode(part) == [x.ids for x in theirs.encode_batch(part, add_special_tokens=False)]


def test_random_texts_and_overlapping_pairs(both):
    ours, theirs = both
    pick = random.Random(5)
    pieces = ["<|endoftext|>", "aaaa", "aaa", "'s", "'ll", " ", "\n", "\t", "  ", "é", "日本", "😀", "1", "!!", "ab", "the", "\x1c", "\x85"]
    texts = ["".join(pick.choices(pieces, k=pick.randrange(40))) for _ in range(3000)]
    texts += ["ab" * 5000, "a" * 10_001, "", " " * 300]
    assert ours.encode(texts) == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ours.decode(x) for x in ours.encode(texts)] == texts


def test_merges_make_pairs_of_higher_rank_only(both):
    ours, _ = both
    made_at = {ours.made[k]: r for k, r in ours.rank.items()}
    assert all(made_at.get(t, -1) < r for k, r in ours.rank.items() for t in (k >> 16, k & 0xFFFF))


def test_round_trip_over_documents(spark, both):
    _, theirs = both
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs).collect():
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "a b", "y"), (3, "a b", "y"), (3, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted((r.doc_id or -1, r.n_tokens, r.ids) for r in bpe.encode(docs).collect())
    assert [x[:2] for x in out] == [(-1, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {1: "", 2: "", None: "a b", 3: "a b"}
    assert bpe.round_trip(docs.limit(0)).count() == 0
