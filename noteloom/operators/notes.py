"""Questions to a library of lectures and notes: filters, reviews, versions, attempts, photos in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lecture_filter(lectures: DataFrame, subject: str | None = None, tags: DataFrame | None = None, tag: str | None = None, least_chars: int | None = None) -> DataFrame:
    """Lectures of a subject, that have a tag, of a least length; what isn't given doesn't matter. lectures: lecture_id, subject, n_chars;
    tags: lecture_id, tag. A lecture that is tagged twice stays one row."""
    if subject is not None:
        lectures = lectures.filter(F.col("subject") == subject)
    if least_chars is not None:
        lectures = lectures.filter(F.col("n_chars") > least_chars)
    if tag is not None:
        lectures = lectures.join(tags.filter(F.col("tag") == tag).select("lecture_id"), "lecture_id", "left_semi")
    return lectures


def review_stats(reviews: DataFrame, key: str) -> DataFrame:
    """Number of reviews and mean stars by lecture or user. reviews: key, stars."""
    return reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("stars"), 9).alias("mean_stars"))


def latest_version(versions: DataFrame, key: str, value: str) -> DataFrame:
    """The newest version's value (also if it is null) and time of each key; ties in time go by seq. versions: key, value, ts, seq."""
    return versions.groupBy(key).agg(F.max_by(value, F.struct("ts", "seq")).alias(value), F.max("ts").alias("ts"))


def qa_attempts(attempts: DataFrame, least: float, order: str = "struct(attempt, model_rank, call_id)") -> DataFrame:
    """Of each prompt the first attempt whose score reaches the threshold, else the last one, flagged. attempts: prompt_id, call_id, score."""
    best = attempts.groupBy("prompt_id").agg(F.expr(f"min_by(call_id, {order}) FILTER (WHERE score >= {float(least)})").alias("good"), F.expr(f"max_by(call_id, {order})").alias("last"))
    return best.select("prompt_id", F.coalesce("good", "last").alias("call_id"), F.isnull("good").alias("flagged"))


def photo_section_asof(photos: DataFrame, sections: DataFrame) -> DataFrame:
    """Photos with the section that has begun last when each was taken: both in one stream of time per lecture, carried forward. A
    photo before the first section has none and goes. photos: lecture_id, at and more; sections: lecture_id, section_no, start_s."""
    rest = [c for c in photos.columns if c not in ("lecture_id", "at")]
    none = lambda c: F.lit(None).cast(photos.schema[c].dataType).alias(c)
    number: Column = F.lit(None).cast(sections.schema["section_no"].dataType)
    taken = photos.select("lecture_id", "at", F.lit(1).alias("turn"), number.alias("section_no"), *rest)
    starts = sections.select("lecture_id", F.col("start_s").alias("at"), F.lit(0).alias("turn"), "section_no", *(none(c) for c in rest))
    w = Window.partitionBy("lecture_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = taken.unionByName(starts).withColumn("section_no", F.last("section_no", ignorenulls=True).over(w))
    return rows.filter("turn = 1 AND section_no IS NOT NULL").select(*rest, "lecture_id", "section_no")
