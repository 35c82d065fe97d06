"""Structured Streaming forms of the event operators; each has its batch form in noteloom.operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from noteloom.operators import events as ev
from noteloom.operators import transcript as tr


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet files that arrive in a folder; ts becomes a timestamp."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def status_fold_stream(events: DataFrame) -> DataFrame:
    """Latest state by task, in update mode. The order is that of seq, so late rows change nothing that is newer."""
    return ev.status_fold(events)


def call_rate_stream(calls: DataFrame, window: str = ev.RATE_WINDOW, slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """Windows that are complete, in append mode; calls later than `late` are dropped."""
    return ev.call_rate(calls.withWatermark("ts", late), window, slide)


def block_intervals_stream(calls: DataFrame, gap: str = ev.GAP, late: str = "2 minutes") -> DataFrame:
    """Blocks that have ended, in append mode, from rate-limited and overloaded calls."""
    return ev.block_intervals(ev.error_marks(calls.withWatermark("ts", late)), gap)


def asr_ingest_stream(chunks: DataFrame) -> DataFrame:
    """Words with absolute times from arriving chunk files; stateless."""
    rows = chunks.select("lecture_id", "chunk_no", F.posexplode("words").alias("pos", "w"))
    rows = rows.select("lecture_id", "chunk_no", "pos", F.col("w.word").alias("word"), F.col("w.start").alias("start_local"), F.col("w.end").alias("end_local"))
    return tr.chunk_offset(tr.word_filter(rows))


def put_batch(target: str):
    """For foreachBatch in update mode: each batch is one folder of a table, so a batch that is run again replaces itself. Read with latest()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id:09d}")

    return write


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last written row of each key of a folder that put_batch() wrote."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(target)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(key, "row.*")


class Counts(StreamingQueryListener):
    """Adds up, over the batches of the queries with the given ids, the metric `rows.seen` that seen() observes."""

    def __init__(self):
        self.seen, self.dropped, self.ended = 0, 0, Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("rows")
        self.seen += row.seen if row else 0
        self.dropped += sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def seen(df: DataFrame) -> DataFrame:
    """The stream with its rows counted as they come in; Counts adds them up."""
    return df.observe("rows", F.count(F.lit(1)).alias("seen"))


def late_rows(counts: Counts, counted: DataFrame, n: str) -> int:
    """How many of the input's rows were dropped as late: those that came in less those that are in the result's counts, once
    all windows are closed. (The operator's own counter is of rows that reach the state, after a batch's partial sums.)"""
    return counts.seen - (counted.agg(F.sum(n)).first()[0] or 0)


def run_arrivals(stream: Callable[[], DataFrame], arrivals: Iterable, mode: str, folder: str, key: str | None = None, counts: Counts | None = None) -> DataFrame:
    """Run a stream, as the function gives it once something is there, over what has arrived, after each arrival, from the same checkpoint, and give its rows as a table; in update mode
    the latest row of each key. What arrives together is one batch, of any number of files."""
    spark, df, out, state = SparkSession.active(), None, f"{folder}/out-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}"
    if counts:
        spark.streams.addListener(counts)
    try:
        for _ in arrivals:
            df = stream()
            if counts:
                counts.ended.clear()
            writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state)
            writer = writer.foreachBatch(put_batch(out)) if mode == "update" else writer.format("parquet").option("path", out)
            writer.start().awaitTermination()
            if counts:
                counts.ended.wait(60)
    finally:
        if counts:
            spark.streams.removeListener(counts)
    return latest(spark, out, key) if mode == "update" else spark.read.schema(df.schema).parquet(out)


def run_once(df: DataFrame, mode: str, folder: str, key: str | None = None) -> DataFrame:
    """Run a stream over what is there."""
    return run_arrivals(lambda: df, [None], mode, folder, key)
