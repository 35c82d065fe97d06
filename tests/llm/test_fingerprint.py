from hashlib import sha256

import numpy as np

from noteloom.llm import fingerprint as fp


def plain_phrases(data: bytes) -> set[bytes]:
    seen, begin = set(), 0
    for end in range(1, len(data) + 1):
        if data[begin:end] not in seen:
            seen.add(data[begin:end])
            begin = end
    return seen


def hash_of(phrase: bytes) -> int:
    h = 0x2545F4914F6CDD1D & fp._MASK
    for b in phrase:
        h = (h * 1000003 ^ b + 1) & fp._MASK
    return h


def plain_sketch(text: str) -> np.ndarray:
    return fp.sketch([0, *map(hash_of, plain_phrases(text.encode()))])


def check(rows, got):
    order = sorted(rows)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r, a, b = by[i], plain_sketch(text), plain_sketch(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
        assert (r.near_edited, r.near_next) == (fp.likeness(a, b), fp.likeness(a, plain_sketch(other)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fp.fingerprints(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_odd_rows(spark):
    rows = [(5, None), (1, ""), (9, "é" * 3000), (-4, "abc"), (7, "日本語のテキスト"), (8, "日本語のテキスト"), (2, "a")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    check(rows, fp.fingerprints(df).collect())
    check(rows[:1], fp.fingerprints(df.filter("doc_id = 5")).collect())
    assert fp.fingerprints(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "z"), (3, "z")], "doc_id long, text string")
    assert len({(r.doc_id, r.fingerprint) for r in fp.fingerprints(same).collect()}) == 2


def test_likeness_follows_the_phrase_sets():
    a, b = "the cat sat on the mat " * 200, "the cat sat on the hat " * 200
    assert fp.likeness(plain_sketch(a), plain_sketch(a)) == 1
    assert fp.likeness(plain_sketch(a), plain_sketch(b)) > fp.likeness(plain_sketch(a), plain_sketch("0123456789" * 400))
