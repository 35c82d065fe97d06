"""Transcript, section, status and pair tables derived from the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("conversations", "documents", "events", "pages", "benchmark")

WORDS = """
SELECT CAST(conv_id AS STRING) AS lecture_id, CAST(turn AS INT) AS chunk_no, pos, word,
       turn * CAST(1200 AS DOUBLE) + pos * CAST(0.4 AS DOUBLE) AS start_s,
       turn * CAST(1200 AS DOUBLE) + pos * CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS end_s
FROM (SELECT conv_id, turn,
             posexplode(filter(split(trim(regexp_replace(text, '[ \\\\t\\\\n\\\\r]+', ' ')), ' '), x -> x <> '')) AS (pos, word)
      FROM {conversations})
"""
WORDS_DUCK = """
SELECT CAST(conv_id AS VARCHAR) AS lecture_id, CAST(turn AS INT) AS chunk_no, CAST(pos AS INT) AS pos, word,
       turn * CAST(1200 AS DOUBLE) + pos * CAST(0.4 AS DOUBLE) AS start_s,
       turn * CAST(1200 AS DOUBLE) + pos * CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS end_s
FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos
      FROM (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
            FROM conversations))
"""
CAPTIONS_DUCK = """
SELECT lecture_id, CAST((rn - 1) // 7 + 1 AS BIGINT) AS caption_no, arg_min(start_s, rn) AS start_s, arg_max(end_s, rn) AS end_s,
       string_agg(word, ' ' ORDER BY rn) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY start_s, chunk_no, pos) AS rn FROM fx_words)
GROUP BY lecture_id, (rn - 1) // 7
"""
SECTIONS = """
SELECT lecture_id, CAST(row_number() OVER (PARTITION BY lecture_id ORDER BY b) - 1 AS INT) AS section_no, start_s,
       coalesce(lead(start_s) OVER (PARTITION BY lecture_id ORDER BY b), end_s) AS end_s
FROM (SELECT lecture_id, floor(start_s / 60) AS b, min(start_s) AS start_s, max(end_s) AS end_s
      FROM {fx_captions} GROUP BY lecture_id, floor(start_s / 60))
"""
STATUS = """
SELECT user_id AS task_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'transcribe' WHEN 'view' THEN 'slides' WHEN 'click' THEN 'structurize' WHEN 'purchase' THEN 'export' END AS stage,
       CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS INT) % 101 END AS progress_pct,
       CASE WHEN event_type = 'error' THEN concat('failed ', CAST(event_id AS STRING)) END AS error,
       CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN concat('/out/', CAST(event_id AS STRING)) END AS result_path
FROM {events}
"""
CALLS = """
SELECT event_id AS call_id, CAST(floor(event_id / 4) AS BIGINT) AS prompt_id, CAST(floor(event_id % 4 / 2) AS INT) + 1 AS attempt,
       CAST(floor(event_id / 2) AS INT) % 5 AS key_id, CAST(event_id % 2 AS INT) AS model_rank, ts,
       event_type <> 'error' AS ok,
       CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN '429 RESOURCE_EXHAUSTED' WHEN 1 THEN '503 UNAVAILABLE' WHEN 2 THEN 'http 429' ELSE 'bad request' END END AS error,
       CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('r', CAST(event_id AS STRING)) END END AS response
FROM {events}
"""
ATTEMPTS = """
SELECT call_id, prompt_id, attempt, key_id, model_rank, ts, ok,
       CASE WHEN NOT ok THEN CASE WHEN (prompt_id + attempt) % 3 < 2 OR call_id % 2 = 0 THEN CASE call_id % 3 WHEN 0 THEN 'http 429' ELSE '429 RESOURCE_EXHAUSTED' END
            WHEN call_id % 5 = 0 THEN 'model unavailable' ELSE 'bad request' END END AS error
FROM {fx_calls}
"""


def pairs_sql(*more: str) -> str:
    """Pairs of a document and each of its derived candidates, with more columns of the document."""
    kept = "".join(f"{c}, " for c in more)
    return f"""
SELECT doc_id AS source_id, candidate, cand_ord, text AS source_text, {kept}candidate_text
FROM (SELECT doc_id, text, {kept}split(text, ' ') AS w, CAST(size(split(text, ' ')) DIV 2 AS INT) AS h
      FROM {{documents}})
LATERAL VIEW stack(4,
  'same', 0, text,
  'head', 1, array_join(slice(w, 1, h), ' '),
  'drop3', 2, array_join(filter(w, (x, i) -> i % 3 <> 2), ' '),
  'swap', 3, array_join(concat(slice(w, h + 1, size(w)), slice(w, 1, h)), ' ')) AS candidate, cand_ord, candidate_text
"""


PAIRS = pairs_sql()
PAIRS_DUCK = """
SELECT source_id, candidate, cand_ord, source_text, candidate_text FROM (
WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w, len(string_split(text, ' ')) // 2 AS h FROM documents)
SELECT doc_id AS source_id, 'same' AS candidate, 0 AS cand_ord, text AS source_text, text AS candidate_text FROM d
UNION ALL SELECT doc_id, 'head', 1, text, array_to_string(w[1:h], ' ') FROM d
UNION ALL SELECT doc_id, 'drop3', 2, text, array_to_string(list_filter(w, lambda x, i: i % 3 <> 0), ' ') FROM d
UNION ALL SELECT doc_id, 'swap', 3, text, array_to_string(list_concat(w[h + 1:], w[1:h]), ' ') FROM d)
"""
SLIDES = "SELECT lecture_id, CAST(slide_no AS INT) AS slide_no, concat('slides/slide-', lpad(CAST(slide_no AS STRING), 2, '0'), '.png') AS path FROM (SELECT lecture_id, explode(sequence(1, 1 + CAST(lecture_id AS INT) % 5)) AS slide_no FROM (SELECT DISTINCT lecture_id FROM {fx_sections}))"
SLIDES_DUCK = "SELECT lecture_id, CAST(slide_no AS INT) AS slide_no, concat('slides/slide-', lpad(CAST(slide_no AS STRING), 2, '0'), '.png') AS path FROM (SELECT lecture_id, unnest(range(1, 2 + CAST(lecture_id AS INT) % 5)) AS slide_no FROM (SELECT DISTINCT lecture_id FROM fx_sections))"
SLIDE_MAP = "SELECT lecture_id, section_no, 0 AS ord, section_no % 7 + 1 AS slide_no FROM {fx_sections} UNION ALL SELECT lecture_id, section_no, 1, section_no * 3 % 7 + 1 FROM {fx_sections}"
AUDIO = "SELECT lecture_id, section_no, concat('audio/', lpad(CAST(section_no + 1 AS STRING), 2, '0'), '-section-', CAST(section_no + 1 AS STRING), '.mp3') AS audio_path FROM (SELECT lecture_id, section_no, max(section_no) OVER (PARTITION BY lecture_id) AS last_no FROM {fx_sections}) WHERE section_no < last_no"
ASR = "SELECT lecture_id, chunk_no, pos, CASE WHEN pos % 50 = 49 THEN ' ' ELSE word END AS word, CAST(pos * CAST(0.4 AS DOUBLE) AS DOUBLE) AS start_local, CASE WHEN pos % 50 <> 25 THEN pos * CAST(0.4 AS DOUBLE) + CAST(0.3 AS DOUBLE) END AS end_local FROM {fx_words}"

SPARK = {
    "fx_words": WORDS, "fx_sections": SECTIONS, "fx_status": STATUS, "fx_calls": CALLS, "fx_attempts": ATTEMPTS, "fx_pairs": PAIRS,
    "fx_slides": SLIDES, "fx_slide_map": SLIDE_MAP, "fx_audio": AUDIO, "fx_asr": ASR,
}
DUCK = SPARK | {"fx_words": WORDS_DUCK, "fx_captions": CAPTIONS_DUCK, "fx_pairs": PAIRS_DUCK, "fx_slides": SLIDES_DUCK}
NEEDS = {"fx_captions": ["fx_words"], "fx_sections": ["fx_captions"], "fx_asr": ["fx_words"], "fx_attempts": ["fx_calls"]} | {k: ["fx_sections"] for k in ("fx_slides", "fx_slide_map", "fx_audio")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by name."""
    if name == "fx_captions":
        from noteloom.operators.transcript import caption_build

        return caption_build(fixture(spark, sf_dir, "fx_words"))
    sql = SPARK[name].replace("\\\\\\\\", "\\\\")
    sources = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    sources |= {n: fixture(spark, sf_dir, n) for n in NEEDS.get(name, []) if "{" + n + "}" in sql}
    return spark.sql(sql, **sources)


PART_BYTES = 2_000_000  # of texts in a partition of derived pairs; their n-grams are some 100 times that in memory


def pairs_with(docs: DataFrame, **more: Column) -> DataFrame:
    """fx_pairs with columns made of documents (doc_id, text), once for all candidates of a document. Documents are dealt by id to
    small partitions, so what is counted by pair has no further shuffle and fits in a task's memory."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.select("doc_id", "text").repartition(-(-size // PART_BYTES) or 1, "doc_id").withColumns(more)
    return docs.sparkSession.sql(pairs_sql(*more), documents=docs)


def duck(*names: str) -> str:
    """WITH clause of DuckDB SQL that defines the fixtures and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    plain = lambda sql: sql.replace("{", "").replace("}", "")
    return "WITH " + ", ".join(f"{n} AS ({plain(DUCK[n]) if 'lambda' not in DUCK[n] else DUCK[n]})" for n in order)
