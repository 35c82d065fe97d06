"""Lectures, notes and chunks go to packs, whose number follows the bytes and not the lectures; candidates are made where their documents are."""

import re

import pytest
from pyspark.sql import functions as F

from noteloom.plans import queries as plans
from noteloom.sources import readers, writers

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["srt_scan", "srt_write", "note_write", "media_manifest"])
def test_no_file_for_each_lecture(spark, name, monkeypatch):
    paths = []
    monkeypatch.setattr(plans, "folder", lambda spark, of: paths.append(folder(spark, of)) or paths[-1])
    rows = plans.QUERIES[name](spark, DATA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths[0]).count()
    assert files == 1 < rows.select("lecture_id").distinct().count()


folder = plans.folder


def test_manifest_of_packs_is_that_of_a_folder(spark, tmp_path):
    files = [("a", "10.txt", "x\n"), ("a", "9.txt", "ü"), ("b", "1.txt", ""), ("b", "0.txt", None), ("ü", "z", "abc")]
    df = spark.createDataFrame(files, "folder string, file string, text string")
    writers.pack_write(df, ["folder", "file"], "text", str(tmp_path / "p"), 1)
    got = sorted((r.folder, r.file, r.bytes, r.no) for r in readers.pack_manifest(spark, str(tmp_path / "p")).collect())
    assert got == [("a", "10.txt", 2, 0), ("a", "9.txt", 2, 1), ("b", "0.txt", -1, 0), ("b", "1.txt", 0, 1), ("ü", "z", 3, 0)]


def test_candidates_move_with_their_documents(spark, tmp_path):
    """A dealt table isn't dealt again; compressed packs give back their texts."""
    docs = spark.createDataFrame([(k, f"w{k} ü x y\n") for k in range(50)], "doc_id long, text string")
    made = spark.sql(plans.pairs_sql("pack"), documents=writers.dealt(docs, ["doc_id"], 5))
    plan = made.groupBy("pack").agg(F.collect_list("candidate_text"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1
    writers.pack_write(made, ["source_id", "candidate"], "candidate_text", str(tmp_path / "c"), compression="gzip")
    got = sorted(map(tuple, readers.pack_scan(spark, str(tmp_path / "c"), "source_id long, candidate string").collect()))
    assert got == sorted((r.source_id, r.candidate, r.candidate_text) for r in made.collect())


def test_no_text_no_pack(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "source_id long, text string")
    writers.pack_write(df.filter("source_id > 1"), ["source_id"], "text", str(tmp_path / "none"), packs=4)
    writers.pack_write(df, ["source_id"], "text", str(tmp_path / "one"), packs=64)  # most tasks have no pack
    assert readers.pack_scan(spark, str(tmp_path / "none"), "source_id long").count() == 0
    assert [tuple(r) for r in readers.pack_scan(spark, str(tmp_path / "one"), "source_id long").collect()] == [(1, "x")]
