"""Transcript, section, event and source operators on small literal tables, and the queries that have no SQL."""

import difflib
import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from noteloom.operators import alignment as al
from noteloom.operators import events as ev
from noteloom.operators import metrics as mt
from noteloom.operators import sections as se
from noteloom.operators import transcript as tr
from noteloom.plans import queries as plans
from noteloom.sources import readers, writers
from noteloom.sources.shared import settled

DATA = "/root/testdata/sf0.001"


def test_captions_of_seven_words(spark):
    words = [("talk", 2, k, f"word{k}", 3.5 + k, 4.25 + k) for k in range(16)] + [("talk", 1, 0, "early", 0.75, 1.5)]
    df = spark.createDataFrame(words, "lecture_id string, chunk_no int, pos int, word string, start_s double, end_s double")
    srt = tr.srt_assemble(tr.caption_build(df)).first().srt
    assert srt.startswith("1\n00:00:00,750 --> 00:00:09,250\nearly word0 word1 word2 word3 word4 word5\n")
    assert "2\n00:00:09,500 --> 00:00:16,250\nword6 word7" in srt and srt.endswith("3\n00:00:16,500 --> 00:00:19,250\nword13 word14 word15")
    assert tr.srt_assemble(tr.caption_build(df.limit(0))).count() == 0


def test_srt_fragment_is_closed_at_both_ends(spark, tmp_path):
    times = [(10.0, 12.25), (12.25, 13.0), (40.5, 44.0), (61.0, 62.0)]
    cues = [f"{k}\n00:{int(a) // 60:02}:{int(a) % 60:02},{int(a % 1 * 1000):03} --> 00:{int(b) // 60:02}:{int(b) % 60:02},{int(b % 1 * 1000):03}\nline {k}" for k, (a, b) in enumerate(times, 1)]
    text = "\n\n".join([*cues[:2], "a block without times", *cues[2:]])
    writers.srt_write(spark.createDataFrame([("talk", text)], "lecture_id string, srt string"), str(tmp_path / "srt"))
    read = readers.srt_scan(spark, str(tmp_path / "srt"))
    assert [(r.cue_no, r.start_s, r.end_s, r.text.strip()) for r in read.orderBy("start_s").collect()] == [(k, a, b, f"line {k}") for k, (a, b) in enumerate(times, 1)]
    sections = spark.createDataFrame([("talk", 0, 13.0, 40.5), ("talk", 1, 45.0, 60.0)], "lecture_id string, section_no int, start_s double, end_s double")
    joined = se.cue_section_join(read.withColumnRenamed("cue_no", "caption_no"), sections)
    fragments = {r.section_no: r for r in se.empty_fragment(se.fragment_assemble(joined)).collect()}
    assert fragments[0].fragment.count("-->") == 2 and "line 2" in fragments[0].fragment and "line 3" in fragments[0].fragment and fragments[0].prompted
    assert fragments[1].fragment == "" and fragments[1].note == se.EMPTY_FRAGMENT and not fragments[1].prompted


def test_note_of_one_section(spark):
    rows = spark.createDataFrame([("talk", 0, "Графы и пути", "00:07:30", "00:19:05", "\n Body of it ", "audio/01-графы-и-пути.mp3")], "lecture_id string, section_no int, title string, start_tc string, end_tc string, content string, audio_path string")
    slides = spark.createDataFrame([("talk", 0, 1, 4, "slides/slide-04.png"), ("talk", 0, 0, 12, None)], "lecture_id string, section_no int, ord int, slide_no int, path string")
    note = se.note_assemble(se.note_sections(rows, slides)).first().note_md
    assert note == "## Графы и пути\n[00:07:30 - 00:19:05] | [Аудио](audio/01-графы-и-пути.mp3)\n\n![Слайд 4](slides/slide-04.png)\n\nBody of it\n"


def test_responses_of_wrong_shape_are_refused_one_by_one(spark):
    rows = [("p", '```json\n[{"title":"Heaps","start":"00:31:10","end":"00:44:59"},{"title":"Tries","start":"00:45:00","end":"00:52:00"}]\n```'), ("q", '{"start":"0"}'), ("r", "sorry"), ("s", "[]")]
    good, bad = readers.split_response_ingest(spark.createDataFrame(rows, "lecture_id string, response string"))
    assert sorted((r.lecture_id, r.section_no, r.title) for r in good.collect()) == [("p", 0, "Heaps"), ("p", 1, "Tries")]
    assert {r.lecture_id for r in bad.collect()} == {"q", "r"}
    rows = [("p", '{"4":["8", 3, 5],"6":"x","9":[]}'), ("q", "7"), ("r", "{}")]
    good, bad = readers.slide_map_ingest(spark.createDataFrame(rows, "lecture_id string, response string"))
    assert sorted((r.lecture_id, r.section_no, r.ord, r.slide_no) for r in good.collect()) == [("p", 4, 0, 8), ("p", 4, 1, 3), ("p", 4, 2, 5)]
    assert {r.lecture_id for r in bad.collect()} == {"q"}


def test_text_pairs_templates_and_media(spark, tmp_path):
    for path, text in [("s/source_id=1/a.txt", "source one"), ("c/source_id=1/candidate=x/b.txt", "cand\nx"), ("t/section.md", "Hi {title}"), ("m/deck/slide-02.png", "22"), ("m/deck/slide-01.png", "1")]:
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [tuple(r) for r in readers.text_pair_scan(spark, str(tmp_path / "s"), str(tmp_path / "c")).collect()] == [(1, "source one", "x", "cand\nx")]
    assert [tuple(r) for r in readers.template_scan(spark, str(tmp_path / "t")).collect()] == [("section", "Hi {title}")]
    files = readers.media_manifest(spark, str(tmp_path / "m"), "*.png").orderBy("no").collect()
    assert [(r.folder, r.file, r.bytes, r.no) for r in files] == [("deck", "slide-01.png", 1, 0), ("deck", "slide-02.png", 2, 1)]


def test_error_is_overwritten_by_null_and_the_rest_is_kept(spark):
    rows = [(1, 1, "a", 5, "boom", None), (1, 2, None, None, None, "/p"), (1, 3, None, 7, None, None)]
    df = spark.createDataFrame(rows, "task_id long, seq long, stage string, progress_pct int, error string, result_path string")
    assert tuple(ev.status_fold(df).select("stage", "progress_pct", "error", "result_path").first()) == ("a", 7, None, "/p")
    assert [r.error for r in ev.status_history(df).orderBy("seq").collect()] == ["boom", None, None]


def test_blocks_merge_at_exactly_the_gap(spark):
    """Without arguments the pace is that of the key pools: a block of 60 seconds, 12 calls a minute."""
    rows = [(4, "2031-05-06 07:10:00"), (4, "2031-05-06 07:11:00"), (4, "2031-05-06 07:12:01"), (9, "2031-05-06 07:10:40")]
    marks = spark.createDataFrame(rows, "key_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.key_id, str(r.block_start)[-8:], str(r.block_end)[-8:], r.n_marks) for r in ev.block_intervals(marks).collect())
    assert [x[3] for x in got] == [2, 1, 1]
    calls = spark.createDataFrame([(70, "2031-05-06 07:11:59"), (71, "2031-05-06 07:12:00")], "call_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    alive = {r.call_id: r.alive for r in ev.alive_keys(calls, ev.block_intervals(marks), 6).collect()}
    assert alive == {70: 5, 71: 6}
    calls = spark.createDataFrame([(1, f"2031-05-06 07:{k // 30:02}:{k % 30:02}") for k in range(43)], "key_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n_calls, r.over) for r in ev.call_rate(calls).collect()) == [(13, True), (30, True)]


def test_glossary_and_fillers(spark):
    words = spark.createDataFrame([("L", 0, k, w) for k, w in enumerate(["Dijkstar", "sat", "sat", "of", "the", "cut"])], "lecture_id string, chunk_no int, pos int, word string")
    terms = spark.createDataFrame([("Dijkstra",), ("cat",), ("cup",)], "term string")
    got = {r.word: r.fixed for r in tr.glossary_fix(words, terms).collect()}
    assert got["dijkstar"] == "dijkstra" and got["cut"] == "[?: cut]" and got["sat"] == "sat"
    kept = tr.filler_clean(words.withColumns({"start_s": F.col("pos").cast("double"), "end_s": F.lit(1.0)}))
    assert [r.word for r in kept.orderBy("rn").collect()] == ["Dijkstar", "sat", "cut"]


def test_metrics_of_whole_documents(spark):
    """All pairs of the smallest scale: known alignments of the derived candidates, difflib for each of any length, ranks and report."""
    pairs = settled(plans.pairs_of(spark, DATA), "pairs")
    blocks = settled(al.word_alignment(pairs), "blocks")
    metrics = settled(mt.quality_metrics(pairs, al.alignment_metrics(pairs, blocks)), "metrics")
    rows = {(r.source_id, r.candidate): r for r in metrics.collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(rows) == 4 * docs.count()
    for (_, name), r in rows.items():
        if name == "same":
            assert r.word_seq_ratio == 1 and (r.words_source < 2 or abs(r.fidelity_score - 100) < 1e-9)  # one word has no pairs
        if name == "head" and r.words_candidate:
            assert r.candidate_words_aligned_pct == 100
    found = {}
    for r in blocks.collect():
        found.setdefault((r.source_id, r.candidate), []).append((r.i, r.j, r.n))
    for p in pairs.collect():
        m = difflib.SequenceMatcher(None, p.st, p.ct, autojunk=False)
        merged = []
        for i, j, n in sorted(found.get((p.source_id, p.candidate), [])):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1][2] += n
            else:
                merged.append([i, j, n])
        assert [tuple(x) for x in merged] == [tuple(x) for x in m.get_matching_blocks()[:-1]]
        assert abs(rows[p.source_id, p.candidate].word_seq_ratio - m.ratio()) < 1e-12
    ranked = mt.rank_candidates(metrics).collect()
    assert sum(r.leader for r in ranked) == docs.count() and {r["rank"] for r in ranked} == {1, 2, 3, 4}
    assert all(rows[r.source_id, "same"].fidelity_score <= r.fidelity_score + 1e-9 for r in ranked if r.leader)
    assert {r.candidate: r.n for r in mt.quality_by_candidate(metrics).collect()} == dict.fromkeys(["same", "head", "drop3", "swap"], docs.count()) | {None: 4 * docs.count()}
    top = mt.report_top(metrics).collect()
    assert len(top) == 10 and min(r.fidelity for r in top) >= sorted((r.fidelity_score for r in rows.values()), reverse=True)[9] - 1e-9


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
