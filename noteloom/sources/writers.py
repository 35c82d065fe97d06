"""Sinks: one text file per lecture, packed texts, reports as JSON, manifests as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACK_BYTES = 8_000_000
DIGITS = 12  # of the length of a pack's table, in bytes, at its begin


def srt_write(srt: DataFrame, path: str) -> None:
    """srt: lecture_id, srt."""
    df = srt.select("lecture_id", F.col("srt").alias("value"))
    df.write.mode("overwrite").partitionBy("lecture_id").text(path)


def note_write(notes: DataFrame, path: str) -> None:
    """notes: lecture_id, note_md; the writer adds the final line end."""
    notes.select("lecture_id", F.regexp_replace("note_md", "\n$", "").alias("value")).write.mode("overwrite").partitionBy("lecture_id").text(path)


def bundle_write(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)


def quality_report_write(ranked: DataFrame, path: str) -> None:
    """Ranked metrics as JSON lines, in source order within each file."""
    ranked.sortWithinPartitions("source_id", "rank").write.mode("overwrite").json(path)


def pack_count(size: int | None, pack_bytes: int = PACK_BYTES) -> int:
    """The packs for texts of `size` bytes."""
    return -(-(size or 0) // pack_bytes) or 1


def dealt(texts: DataFrame, keys: list[str], packs: int) -> DataFrame:
    """texts with their pack, by a hash of the keys, a partition for each pack or so."""
    return texts.withColumn("pack", F.pmod(F.xxhash64(*keys), F.lit(packs))).repartition(packs, "pack")


def pack_write(texts: DataFrame, keys: list[str], text: str, path: str, pack_bytes: int = PACK_BYTES, packs: int | None = None, compression: str = "none") -> None:
    """Many texts to a file. A file is a pack: the length of its table, the table (JSON: keys, place and bytes of each text; -1: null)
    and then the texts end to end. Packs have about `pack_bytes` of texts each, dealt by a hash of the keys, so a corpus of small
    texts needs few files, and texts move once; not at all if they are dealt() already. With the number of `packs` texts are made once,
    else a second time to add up their sizes."""
    if "pack" not in texts.columns:
        texts = dealt(texts, keys, packs or pack_count(texts.agg(F.sum(F.octet_length(text))).first()[0], pack_bytes))
    sized = texts.select("pack", *keys, F.col(text).alias("text")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long"))
    room = F.greatest("bytes", F.lit(0))
    w = Window.partitionBy("pack").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = F.array_sort(F.collect_list(F.struct("at", *keys, "bytes", "text")))  # a pack's worth of texts
    packed = sized.withColumn("at", F.sum(room).over(w) - room).groupBy("pack").agg(rows.alias("rows"))
    table = F.to_json(F.transform("rows", lambda r: F.struct(*(r[k].alias(k) for k in keys), r["at"].alias("at"), r["bytes"].alias("bytes"))))
    packed = packed.select(table.alias("table"), F.array_join(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("body"))
    value = F.concat(F.lpad(F.octet_length("table").cast("string"), DIGITS, "0"), "table", "body")
    packed.select(value.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", compression).text(path)
