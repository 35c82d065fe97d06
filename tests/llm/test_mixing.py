import numpy as np
import pytest

from noteloom.llm import mixing as mx


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs, mx.labelled_domains(docs, spark.read.parquet(f"{d}/labels.parquet"))


def test_expected_totals_match_the_targets(tables):
    docs, labelled = tables
    names = list(mx.WEIGHTS)
    weights, prior = mx.classifier(docs, labelled, names)
    members = mx.stored(mx.posteriors(docs, weights, prior), "members")
    rows = members.collect()
    assert len(rows) == docs.count()
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.n_tokens >= 0 for r in rows)
    n, p = np.array([r.n_tokens for r in rows], float), np.array([r.p for r in rows])
    targets = n.sum() * np.array([mx.WEIGHTS[d] for d in names])
    got = mx.solve_rates(members, targets).collect()
    rate = np.array([r.r for r in got])
    assert rate.min() >= 0
    assert np.abs((rate * n) @ p - targets).max() < 1e-3 * n.sum()
    # the same iteration, plainly
    r, weigh = np.ones(len(n)), np.linalg.inv((p.T * n) @ p + np.eye(len(names)) * n.sum() * 1e-9)
    for _ in range(mx.ITERATIONS):
        rest = (r * n) @ p - targets
        if np.abs(rest).max() <= 1e-6 * n.sum():
            break
        r = np.maximum(0, r - p @ (weigh @ rest))
    assert np.allclose(sorted(rate), sorted(r), atol=1e-6)


def test_classifier_finds_most_domains_of_rows_it_has_not_seen(tables):
    docs, labelled = tables
    fitted = labelled.filter("doc_id % 2 = 0")
    told = {r.doc_id: r.domain for r in labelled.filter("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.domain for r in mx.mix(docs, fitted, mx.WEIGHTS).collect()}
    assert np.mean([got[i][:2] == d[:2] for i, d in told.items()]) > 0.9


def test_mixed_keeps_every_row(tables):
    docs, labelled = tables
    out = mx.mixed(docs, labelled)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.count()
    assert docs.count() < out.count() < 3 * docs.count()


def test_words_are_what_white_space_separates(spark):
    docs = spark.createDataFrame([(1, " a\tb\nc\x0b\x0cd\r\ne  f", "en"), (2, "\u00a0g\u2003h", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.n_tokens for r in mx.mix(docs, docs.selectExpr("doc_id", "'en:1' AS domain"), mx.WEIGHTS).collect()}
    assert got == {1: 6, 2: 1}


def test_posteriors_against_a_plain_classifier(spark, tables):
    docs, labelled = tables
    names = list(mx.WEIGHTS)
    weights, prior = mx.classifier(docs, labelled, names)
    table = {r.slot: [r[f"w{k}"] for k in range(len(names))] for r in weights.collect()}
    rows = mx.posteriors(docs, weights, prior).orderBy("doc_id").limit(60).collect()
    slots = {}
    for r in mx.word_rows(docs, "doc_id").collect():
        slots.setdefault(r.doc_id, []).append(r.slot)
    for r in rows:
        own = [table[x] for x in slots[r.doc_id] if x is not None]
        n = len(own)
        logits = np.array(prior) + (np.mean(own, 0) * n * mx.EVIDENCE / (n + mx.EVIDENCE) if n else 0)
        p = np.exp(logits - logits.max())
        assert np.allclose(p / p.sum(), r.p) and n == r.n_tokens


def test_odd_rows(spark, tables):
    _, labelled = tables
    rows = [(1, None, "en"), (2, "", None), (None, "the and", "en"), (3, "a b", "de"), (3, "a b", "de"), (4, "x " * 50_000, "xx")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, rate double")
    for known in (labelled, labelled.limit(0)):
        got = mx.mix(docs, known, mx.WEIGHTS).collect()
        assert len(got) == 6 and all(r.rate >= 0 for r in got)
        assert len({r.rate for r in got if r.doc_id == 3}) == 1
    assert mx.mix(docs.limit(0), labelled, mx.WEIGHTS).count() == 0
    assert mx.mixed(docs, labelled.limit(0)).count() >= 6


def test_rows_of_one_labelled_id_teach_once_each(spark):
    rows = [(1, "one", "en"), (1, "one", "en"), (1, "one", "de"), (2, "three", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    domains = ["de:1", "fr:1"]
    labelled = mx.labelled_domains(docs, labels).unionByName(mx.labelled_domains(docs, labels))
    weights, prior = mx.classifier(docs, labelled, domains)
    slot = mx.word_rows(docs.filter("doc_id = 1"), "doc_id").first().slot
    got = {r.slot: r.w0 - r.w1 for r in weights.collect()}[slot]
    # three rows of id 1, each counted once, all of the first of its domains; one row of id 2
    assert np.isclose(got, np.log(3.5 / (3 + 0.5 * mx.SLOTS)) - np.log(0.5 / (1 + 0.5 * mx.SLOTS)))
    assert prior == [float(np.log(2 / 4))] * 2
