import corpus_pipeline as cp
from noteloom.llm import bpe
from noteloom.llm.common import stored
from tests.llm.test_near_dedup import UPPER, plain


def test_stages_against_plain_versions(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    outs = []
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, d), name.replace(" ", "-"))
        outs.append((before, docs))
    rows = [[(r.doc_id, r.text) for r in out.collect()] for _, out in outs[:4]]
    assert all(out.columns == outs[0][0].columns for _, out in outs[:4])
    assert set(rows[0]) <= {(r.doc_id, r.text) for r in outs[0][0].collect()}
    last = {}
    for i, t in rows[0]:
        key = (t or "").translate(UPPER)
        last[key] = max(i, last.get(key, -1))
    assert {i for i, _ in rows[1]} == set(last.values())
    assert {i for i, _ in rows[2]} == {c for _, c in plain(rows[1], 80).values()}
    assert set(rows[3]) == set(rows[2]) and len(rows[3]) >= len(rows[2])
    encoded = docs.collect()
    vocab, texts = bpe.vocabulary(bpe.default_vocabulary()), dict(rows[3])
    assert sorted(r.doc_id for r in encoded) == sorted(i for i, _ in rows[3])
    assert all(vocab.decode(r.ids) == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in encoded)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, comp string, kept_id long, `mix copies` int"


def written(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like those of the stages: nothing crashes, every
    different text is there in the end, copies and near copies once per id that stays."""
    base = " ".join(f"word{k}" for k in range(200))
    row = lambda i, t, lang="en": (i, t, lang, None, None, None, "c", 7, 3)
    rows = [row(1, None), row(2, ""), row(3, " \t\n"), row(4, base), row(5, base.upper()), row(6, base + " one more"), row(7, "x " * 200_000), row(8, "single", None)]
    rows += [row(9, "twice the same row"), row(9, "twice the same row"), row(None, "nobody's text"), row(11, "été " * 30, "fr")]
    d = written(spark, tmp_path, rows, [(4, 1, 0), (8, None, None), (None, 1, 1), (4, 1, 0)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES[:4]:
        docs = stored(stage(spark, docs, d), name.replace(" ", "-"))
        assert docs.columns == [x.split()[0].strip("`") if "mix" not in x else "mix copies" for x in ODD.split(", ")]
    ids = {r.doc_id for r in docs.collect()}
    assert ids == {2, 3, 5, 7, 8, 9, None, 11}  # 1 is a copy of 2, 4 of 5, and 6 nearly
    encoded = cp.encode(spark, docs, d).collect()
    assert {r.doc_id for r in encoded} == ids and all(r.n_tokens == len(r.ids) for r in encoded)
    assert all((r.n_tokens == 0) == (r.doc_id == 2) for r in encoded)


def test_empty_tables(spark, tmp_path):
    d = written(spark, tmp_path, [], [])
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == 0
