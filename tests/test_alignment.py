"""The set-based alignment against the standard library's matcher."""

import difflib
import random
import re

import numpy as np

from noteloom.operators import alignment as al
from noteloom.operators import metrics as mt
from noteloom.plans import fixtures
from noteloom.plans import queries as plans

SCHEMA = "source_id long, candidate string, cand_ord int, source_text string, candidate_text string"


def test_blocks_equal_difflib(spark):
    pick = random.Random(1)
    rows = []
    for k in range(150):
        words = [f"w{x}" for x in range(pick.randrange(2, 30))]
        a = pick.choices(words, k=pick.randrange(0, 70))
        b = pick.choices(words, k=pick.randrange(0, 70)) if k % 2 else [w for w in a if pick.random() < 0.8]
        rows.append((k, "c", 0, " ".join(a), " ".join(b)))
    pairs = al.settled(mt.token_pairs(spark.createDataFrame(rows, SCHEMA)), "pairs")
    blocks = {}
    for r in al.word_alignment(pairs).collect():
        blocks.setdefault(r.source_id, []).append((r.i, r.j, r.n))
    sums = {r.source_id: r for r in al.alignment_metrics(pairs, al.word_alignment(pairs)).collect()}
    for k, _, _, a, b in rows:
        m = difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False)
        merged = []
        for i, j, n in sorted(blocks.get(k, [])):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1][2] += n
            else:
                merged.append([i, j, n])
        assert [tuple(x) for x in merged] == [tuple(x) for x in m.get_matching_blocks()[:-1]]
        assert abs(sums[k].word_seq_ratio - m.ratio()) < 1e-12


def test_quality_of_known_pairs(spark):
    rows = [
        (1, "same", 0, "alpha beta. gamma delta", "alpha beta. gamma delta"), (1, "short", 1, "alpha beta. gamma delta", "alpha beta."),
        (1, "other", 2, "alpha beta. gamma delta", "foo bar baz"), (2, "empty", 0, "", ""), (3, "nothing", 0, "a b", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = mt.token_pairs(df)
    got = {(r.source_id, r.candidate): r for r in mt.rank_candidates(mt.quality_metrics(df, al.alignment_metrics(pairs, al.word_alignment(pairs)))).collect()}
    same, short = got[1, "same"], got[1, "short"]
    assert (same.word_seq_ratio, same.base_words_preserved_pct, same.rouge2_recall, same.compression_pct) == (1, 100, 1, 0)
    assert abs(same.fidelity_score - 100) < 1e-9 and same.leader
    assert short.base_words_preserved_pct == 50 and short.compression_pct == 50 and short.fidelity_score < 100
    assert [got[1, c]["rank"] for c in ("same", "short", "other")] == [1, 2, 3]
    assert got[2, "empty"].word_seq_ratio == 1 and got[2, "empty"].compression_pct == 100
    assert got[3, "nothing"].compression_pct == 100 and got[3, "nothing"].readability_score == 36


def test_rounds_go_on_until_no_region_is_open(spark):
    """Runs of five lengths, each in the gap that the longer ones leave."""
    runs = [[f"r{n}x{k}" for k in range(n)] for n in (5, 4, 3, 2, 1)]
    a = " ".join(" ".join([*run, f"a{k}"]) for k, run in enumerate(runs))
    b = " ".join(" ".join([*run, f"b{k}"]) for k, run in enumerate(runs))
    pairs = al.settled(mt.token_pairs(spark.createDataFrame([(1, "c", 0, a, b)], SCHEMA)), "pairs")
    got = sorted((r.i, r.j, r.n) for r in al.word_alignment(pairs).collect())
    assert got == [tuple(x) for x in difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_matching_blocks()[:-1]]


def test_quality_takes_one_pass(spark, monkeypatch):
    """Nothing of a pair is stored or shuffled, and slices of any size and few matches at a time count alike."""
    stored = []
    monkeypatch.setattr(fixtures, "PART_BYTES", 50_000)
    monkeypatch.setattr(plans, "settled", lambda df, name: stored.append(name) or al.settled(df, name))
    metrics = plans.quality(spark, "/root/testdata/sf0.001")
    assert re.findall(r"Exchange (\w+\(?\w+)", metrics._jdf.queryExecution().executedPlan().toString()) == ["hashpartitioning(doc_id"] and not stored
    assert metrics.count() == 800


def test_blocks_of_slices_equal_difflib(monkeypatch):
    monkeypatch.setattr(al, "MATCHES", 11)
    pick, sides = random.Random(3), []
    for k in range(200):
        a = pick.choices(range(pick.randrange(1, 12)), k=pick.randrange(0, 60))
        sides.append((a, a[len(a) // 2 :] + a[: len(a) // 2] if k % 3 == 0 else [x for x in a if pick.random() < 0.7] if k % 3 == 1 else pick.choices(range(5), k=40)))
    tokens = np.array([x for side in (0, 1) for pair in sides for x in pair[side]], np.int64)
    a, b = (np.concatenate([[0], np.cumsum([len(p[side]) for p in sides])]) for side in (0, 1))
    b = b + a[-1]
    equal = {}
    for p, i, j, n in al._blocks(tokens, a, b, al.LEVELS).T.tolist():
        equal.setdefault(p, set()).update((i - a[p] + k, j - b[p] + k) for k in range(n))
    for p, (x, y) in enumerate(sides):
        want = {(m.a + k, m.b + k) for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for k in range(m.size)}
        assert equal.get(p, set()) == want
