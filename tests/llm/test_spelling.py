import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.llm import spelling as sp

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(words):
    """word -> (form, root, n, n_near, form_n); near words by the words that one deletion makes."""
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by[x].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain(plain_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert result(sp.op13_spelling(spark, "/root/testdata/sf0.01")) == want
    assert sum(1 for x in want.values() if x[0]) > 20


@pytest.mark.parametrize(("qmin", "qmax", "most"), [(2, 4, 40), (2, 6, 100_000), (3, 3, 10)])
def test_words_of_few_letters_meet_under_all_dictionaries(spark, qmin, qmax, most):
    """Dictionaries without extensions, and ones so large that an edit may affect all grams of many words."""
    pick = random.Random(qmax)
    words = {"".join(pick.choices("abä", k=pick.randrange(7, 10))): pick.choice([2, 20, 30, 400, 4000]) for _ in range(1500)}
    words |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaaa": 2000, "x" * 300: 5, "x" * 301: 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    d = sp.dictionary(df, qmin, qmax, most)
    weak = sum(len(g := d.of(f"^{w}$")) <= d.affected(f"^{w}$", g) for w in words)
    assert (qmax == qmin) == (not d.grams) and (weak > 100 if qmax == 6 else True)
    assert result(sp.variants(df, d)) == plain(words)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=7, max_size=12), st.integers(0, 12), st.sampled_from("abcd"), st.sets(st.text("abc", min_size=3, max_size=5), max_size=40))
def test_no_edit_changes_more_grams_than_the_bound(word, at, letter, grams):
    d = sp.Decomposer({g[:k] for g in grams for k in range(3, len(g) + 1)}, 2, 5)
    of = lambda w: [f"^{w}$"[i:j] for i, j in d.of(f"^{w}$")]
    at = min(at, len(word))
    for other in (word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]):
        for a, b in ((word, other), (other, word)):
            lost = sum((Counter(of(a)) - Counter(of(b))).values())
            assert a == b or lost <= d.affected(f"^{a}$", d.of(f"^{a}$"))


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "short 12 ümläute ümläute"), (4, "ÄBCDEFG äbcdefg ÄBCdefg"), (5, "Repeated repeated"), (5, "Repeated repeated"), (None, "reporter reporter\nREPORTER×y ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    words = sp.perturbed_words(docs)
    want = plain_words(rows)
    assert {r.word: r.n for r in words.collect()} == want and want["Äbcdefg"] == 2 and "reporter" in want
    rows = [(2, "variant " * 200_000 + "variamt variamt")]
    got = result(sp.variants(sp.perturbed_words(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == plain(plain_words(rows)) and got["variamt"][0] == "variant"
    assert sp.variants(sp.perturbed_words(docs.filter(F.lit(False)))).count() == 0
