"""Scans of transcript files, model responses and templates, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.sources import writers

ASR_SCHEMA = "lecture_id string, chunk_no int, words array<struct<word: string, start: double, end: double>>"
SECTION_JSON = "array<struct<title: string, start: string, end: string>>"


def srt_cues(texts: DataFrame) -> DataFrame:
    """Cues of SRT texts (lecture_id, srt): blocks parted by blank lines; a block without times is dropped."""
    blocks = texts.select("lecture_id", F.posexplode(F.split(s.strip(F.col("srt")), "\n\n+")).alias("at", "block"))
    tc = lambda k: F.regexp_extract("block", s.BLOCK_TIMES, k)
    rows = blocks.withColumns({"start_tc": tc(1), "end_tc": tc(2)}).filter("start_tc <> ''")
    number = F.row_number().over(Window.partitionBy("lecture_id").orderBy("at"))
    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    return rows.select(
        "lecture_id", number.alias("cue_no"), "start_tc", "end_tc", s.parse_tc(F.col("start_tc")).alias("start_s"), s.parse_tc(F.col("end_tc")).alias("end_s"), body.alias("text"), "block"
    )


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file of a folder tree."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def partition_value(path, name: str):
    return F.regexp_extract(path, f"{name}=([^/]+)", 1)


def srt_scan(spark: SparkSession, path: str) -> DataFrame:
    """Cues of the SRT files under path, whose folders are lecture_id=... ."""
    texts = whole_texts(spark, path)
    return srt_cues(texts.select(partition_value(F.col("path"), "lecture_id").alias("lecture_id"), F.col("text").alias("srt")))


def asr_words_scan(spark: SparkSession, path: str) -> DataFrame:
    """Word rows of recognition payloads, one JSON object per line; no or null words give no rows."""
    rows = spark.read.schema(ASR_SCHEMA).json(path).select("lecture_id", "chunk_no", F.posexplode("words").alias("pos", "w"))
    return rows.select("lecture_id", "chunk_no", "pos", F.col("w.word").alias("word"), F.col("w.start").alias("start_local"), F.col("w.end").alias("end_local"))


def media_manifest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(folder, file, bytes, no): files in order of name within their folder, numbered from 0. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"))
    return rows.withColumn("no", F.row_number().over(Window.partitionBy("folder").orderBy("file")) - 1)


def split_response_ingest(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of responses that hold a JSON array, and the responses that don't.

    The first character is looked at, because from_json would take a single object for an array of one.
    """
    text = s.strip_fence(F.col("response"))
    rows = responses.withColumn("parsed", F.when(text.startswith("["), F.from_json(text, SECTION_JSON)))
    good = rows.filter("parsed IS NOT NULL").select("lecture_id", F.posexplode("parsed").alias("section_no", "x"))
    good = good.select("lecture_id", "section_no", F.col("x.title").alias("title"), F.col("x.start").alias("start_tc"), F.col("x.end").alias("end_tc"))
    return good, rows.filter("parsed IS NULL").drop("parsed")


def slide_map_ingest(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lecture_id, section_no, ord, slide_no) of responses that hold a JSON object, and the others. Values that aren't lists are skipped one by one."""
    text = s.strip_fence(F.col("response"))
    rows = responses.withColumn("parsed", F.when(text.startswith("{"), F.from_json(text, "map<string,string>")))
    entries = rows.filter("parsed IS NOT NULL").select("lecture_id", F.explode("parsed").alias("k", "v")).filter(F.col("v").startswith("["))
    items = entries.select("lecture_id", F.col("k").try_cast("int").alias("section_no"), F.posexplode(F.from_json("v", "array<string>")).alias("ord", "item"))
    return items.select("lecture_id", "section_no", "ord", F.col("item").try_cast("int").alias("slide_no")), rows.filter("parsed IS NULL").drop("parsed")


def text_pair_scan(spark: SparkSession, sources: str, candidates: str) -> DataFrame:
    """Pairs of source files (source_id=...) and candidate files (source_id=.../candidate=...)."""
    a, b = whole_texts(spark, sources), whole_texts(spark, candidates)
    a = a.select(partition_value(F.col("path"), "source_id").cast("long").alias("source_id"), F.col("text").alias("source_text"))
    b = b.select(partition_value(F.col("path"), "source_id").cast("long").alias("source_id"), partition_value(F.col("path"), "candidate").alias("candidate"), F.col("text").alias("candidate_text"))
    return a.join(b, "source_id")


def _packs(spark: SparkSession, path: str, keys: str):
    """The packs that pack_write() wrote under path, the place of their tables' end and the rows of the table of a pack."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").text(path, wholetext=True).filter("value <> ''")  # a task without packs may leave an empty file
    fields, digits = ", ".join(k.strip().replace(" ", ": ", 1) for k in keys.split(",")), writers.DIGITS
    end = lambda content: F.decode(F.substring(content, 1, digits), "UTF-8").cast("int") + digits
    rows = lambda content: F.from_json(F.decode(F.substr(content, F.lit(digits + 1), end(content) - digits), "UTF-8"), f"array<struct<{fields}, at: bigint, bytes: bigint>>")
    return files.select(F.col("value").cast("binary").alias("content")), end, rows


def pack_scan(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """(keys, text) of the packs that pack_write() wrote under path; keys: their names and types. A task reads whole packs; each text
    is cut out of its pack's bytes by the pack's own table, so nothing is joined or shuffled."""
    files, end, rows = _packs(spark, path, keys)
    names = [k.split()[0] for k in keys.split(",")]

    def texts(content):
        def cut(row):
            text = F.decode(F.substr(content, (end(content) + 1 + row["at"]).cast("int"), row["bytes"].cast("int")), "UTF-8")
            return F.struct(*(row[k].alias(k) for k in names), F.when(row["bytes"] >= 0, text).alias("text"))

        return F.transform(rows(content), cut)

    # cut before they are rows, else each row would have a copy of its pack; as a lambda's variable the pack isn't copied for each text
    return files.select(F.inline(F.transform(F.array("content"), texts)[0]))


def pack_manifest(spark: SparkSession, path: str) -> DataFrame:
    """media_manifest of packs of files that are keyed by folder and file: (folder, file, bytes, no), from the packs' tables alone."""
    files, _, rows = _packs(spark, path, "folder string, file string")
    found = files.select(F.inline(rows(F.col("content")))).select("folder", "file", "bytes")
    return found.withColumn("no", F.row_number().over(Window.partitionBy("folder").orderBy("file")) - 1)


def packed_pair_scan(spark: SparkSession, sources: str, candidates: str) -> DataFrame:
    """text_pair_scan of packs: sources by source_id, candidates by source_id and candidate."""
    a = pack_scan(spark, sources, "source_id long").withColumnRenamed("text", "source_text")
    return a.join(pack_scan(spark, candidates, "source_id long, candidate string").withColumnRenamed("text", "candidate_text"), "source_id")


def template_scan(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of template files."""
    return whole_texts(spark, path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), F.col("text").alias("body"))
