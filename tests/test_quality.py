"""All quality metrics of all pairs of the smallest scale against the formulas written out, and ranks and report from these."""

import json
import re
from collections import Counter
from statistics import median

from noteloom.operators import alignment as al
from noteloom.operators import metrics as mt
from noteloom.operators import numbering
from noteloom.plans import queries as plans
from noteloom.sources import writers
from noteloom.sources.shared import settled

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[A-Za-zА-Яа-яЁё0-9]+")


def div(a, b):
    return a / b if b else 0.0


def cleaned(text, source):
    if source:
        text = re.sub(r"(?m)^\s*\d{2}:\d{2}:\d{2}[,.:]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.:]\d{3}.*$", " ", text)
        text = re.sub(r"<[^>]+>", " ", re.sub(r"(?m)^\s*\d+\s*$", " ", text))
        return re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"(?m)^---\s*$", " ", re.sub(r"(?m)^#{1,6}\s*", "", text))
    return re.sub(r"[*_`>#]+", " ", re.sub(r"\[\d\d:\d\d:\d\d\s*-\s*\d\d:\d\d:\d\d\]", " ", text))


def sentences(text):
    parts = (re.sub(" +", " ", re.sub("[^A-Za-zА-Яа-яЁё0-9 ]+", " ", x.lower())).strip() for x in re.split(r"(?<=[.!?])\s+", text))
    return {x for x in parts if x}


def metrics_of(source, candidate, equal):
    a, b = cleaned(source, True), cleaned(candidate, False)
    x, y = ([w.lower() for w in WORD.findall(t)] for t in (a, b))
    ss, cs = sentences(a), sentences(b)
    out = {"chars_source": len(source), "chars_candidate": len(candidate), "words_source": len(x), "words_candidate": len(y)}
    for n in (1, 2):
        g, h = (Counter(zip(*(t[k:] for k in range(n)))) for t in (x, y))
        over = sum((g & h).values())
        r, p = div(over, max(0, len(x) - n + 1)), div(over, max(0, len(y) - n + 1))
        out |= {f"rouge{n}_recall": r, f"rouge{n}_precision": p, f"rouge{n}_f1": div(2 * p * r, p + r)}
    kept, less = div(equal, len(x)) * 100, (1 - div(len(y), len(x))) * 100
    ratio = div(2 * equal, len(x) + len(y)) if x or y else 1.0
    novel = div(len(set(y) - set(x)), max(1, len(set(y)))) * 100
    out |= {"word_seq_ratio": ratio, "base_words_preserved_pct": kept, "candidate_words_aligned_pct": div(equal, len(y)) * 100, "compression_pct": less, "vocab_jaccard": div(len(set(x) & set(y)), len(set(x) | set(y))), "novel_vocab_pct": novel}
    out |= {"sentence_overlap_pct": div(len(ss & cs), max(1, len(cs))) * 100, "readability_score": max(0.0, 100 - 4 * abs(div(len(y), max(1, len(cs))) - 16))}
    out["fidelity_score"] = 0.30 * kept + 0.25 * out["rouge1_recall"] * 100 + 0.20 * out["rouge2_recall"] * 100 + 0.20 * ratio * 100 + 0.05 * max(0, 100 - 2 * abs(less))
    out["rewrite_aggressiveness"] = min(100, 0.6 * (100 - kept) + 0.3 * max(0, less) + 0.1 * novel)
    return out


def test_all_columns_of_all_pairs(spark, tmp_path):
    sides = plans.sides_of(spark, DATA)
    aligned = settled(plans.aligned(spark, DATA, sides), "aligned")
    equal = {(r.source_id, r.candidate): r.equal_words for r in aligned.collect()}
    metrics = settled(mt.quality_metrics(sides, aligned), "metrics")
    rows = {(r.source_id, r.candidate): r for r in metrics.collect()}
    pairs = {(r.source_id, r.candidate): r for r in plans.fixture(spark, DATA, "fx_pairs").collect()}
    assert rows.keys() == pairs.keys()
    for k, p in pairs.items():
        want = metrics_of(p.source_text, p.candidate_text, equal[k])
        assert len(want) == 20
        for name, value in want.items():
            assert abs(rows[k][name] - value) < 1e-9, (k, name)
    same = mt.quality_metrics(plans.fixture(spark, DATA, "fx_pairs").filter("source_id % 40 = 0"), aligned)  # pairs without stored sides
    assert all(abs(r.fidelity_score - rows[r.source_id, r.candidate].fidelity_score) < 1e-9 for r in same.collect())

    ranked = mt.rank_candidates(metrics)
    by = {}
    for (i, c), r in rows.items():
        by.setdefault(i, []).append((-r.fidelity_score, r.cand_ord, c))
    assert {(r.source_id, r["rank"]): r.candidate for r in ranked.collect()} == {(i, n): x[2] for i, own in by.items() for n, x in enumerate(sorted(own), 1)}
    top = [(r.source_id, r.candidate) for r in mt.report_top(metrics).collect()]
    assert top == [k for k, r in sorted(rows.items(), key=lambda x: (-x[1].fidelity_score, x[0]))[:10]]
    writers.quality_report_write(ranked, str(tmp_path / "report"))
    told = [json.loads(line) for f in (tmp_path / "report").glob("*.json") for line in f.read_text().splitlines()]
    assert len(told) == len(rows)
    for r in told:
        own = rows[r["source_id"], r["candidate"]]
        assert r["leader"] == (r["rank"] == 1) and all(abs(r[c] - own[c]) < 1e-12 for c in ("fidelity_score", "rouge2_recall", "rewrite_aggressiveness"))


def test_candidates_are_cleaned_once(spark):
    """Tokens and sentences of a candidate come from one cleaned text."""
    plan = mt.sides(plans.sides_of(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[*_`>#]+") == 1


def test_metrics_are_made_once_for_all_statistics(spark):
    """Means and medians don't make the metrics anew."""
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    rows = [(k, f"c{k % 3}", float(k * 7 % 100), float(k * 11 % 100)) for k in range(200)]
    df = spark.createDataFrame(rows, "source_id long, candidate string, fidelity_score double, readability_score double").repartition(4)
    got = {r.candidate: r for r in mt.quality_by_candidate(df.mapInArrow(count, df.schema), 3).collect()}
    assert made.value == 200
    assert got[None].n == 200 and got[None].p50_fidelity_score == median([r[2] for r in rows])
    assert got["c1"].p50_readability_score == median([r[3] for r in rows if r[1] == "c1"])


ODD = [
    "One, TWO!  Äö three?\n\tfour--five. ", "...", "a. A. b", "Йод. Ёж! ёж! Ёж", "", None, "1.5 is. not cut", "Kelvin. k elvin. İx i x. I x",
    "# Head\n---\n*x* y_z. [00:01:02 - 00:03:04] b　c!　d", "12\n00:00:01,000 --> 00:00:02,000\n<b>x</b> 7\n\n 8 \n. x. x.", "\U0001f600 a.\U0001f600 b. c?\x85d", "the end", " the end.", "q" * 70,
]


def test_counts_of_texts_are_those_of_lists(spark, monkeypatch):
    """Tokens and sentences found in a slice of texts are those of the expressions, for all pairs of odd texts and of the smallest scale."""
    monkeypatch.setattr(numbering, "SLICE_BYTES", 300)
    rows = [(len(ODD) * i + j, "c", 0, a, b) for i, a in enumerate(ODD) for j, b in enumerate(ODD)]
    schema = "source_id long, candidate string, cand_ord int, source_text string, candidate_text string"
    some = plans.fixture(spark, DATA, "fx_pairs").filter("source_id % 10 = 0")
    pairs = settled(spark.createDataFrame(rows, schema).union(some.select(*schema.replace(",", "").split()[::2])), "odd")
    want = mt.quality_metrics(al.counted(mt.sides(pairs)))
    got = mt.quality_metrics(mt.with_sentences(al.counted_texts(mt.clean_sides(pairs)))).select(*want.columns)
    assert sorted(map(tuple, got.na.fill(-1).collect())) == sorted(map(tuple, want.na.fill(-1).collect()))


def test_quality_makes_no_lists(spark):
    for name in ("quality_metrics", "rouge", "gram_overlap_join"):
        plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "array<string>" not in plan


def test_overlaps_of_texts_are_those_of_lists(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SLICE_BYTES", 300)
    rows = [(len(ODD) * i + j, "c", 0, a, b) for i, a in enumerate(ODD) for j, b in enumerate(ODD)]
    pairs = settled(spark.createDataFrame(rows, "source_id long, candidate string, cand_ord int, source_text string, candidate_text string"), "odd")
    texts, lists = mt.clean_sides(pairs), mt.token_pairs(pairs)
    for f in (mt.rouge, lambda x: mt.gram_overlap_join(x, 2), lambda x: mt.gram_overlap_join(x, 1)):
        assert sorted(map(tuple, f(texts).collect())) == sorted(map(tuple, f(lists).collect()))
