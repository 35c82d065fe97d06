"""Task status and API calls: folds, spacing, rates and block intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.operators.ranges import numbered, running_sum, stretches, with_previous

GAP = "60 seconds"  # how long a key stays blocked
RATE_WINDOW = "1 minute"
RATE = 12
SPACING_S = 5.0


def status_history(events: DataFrame) -> DataFrame:
    """State after each update: stage, progress and path keep their last value, error is always the update's own."""
    w = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = {c: F.last(c, ignorenulls=True).over(w) for c in ("stage", "progress_pct", "result_path")}
    return events.select("task_id", "seq", "error", *(v.alias(c) for c, v in held.items()))


def status_aggs() -> list:
    kept = lambda c: F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    return [F.max("seq").alias("seq"), kept("stage"), kept("progress_pct"), kept("result_path"), F.max_by("error", "seq").alias("error")]


def status_fold(events: DataFrame) -> DataFrame:
    """Final state of each task, by one aggregation."""
    return events.groupBy("task_id").agg(*status_aggs())


def first_success(calls: DataFrame) -> DataFrame:
    """Of each prompt the first success in order of attempt and model, else the last error; an empty response is none."""
    order = "struct(attempt, model_rank, call_id)"
    good = "ok AND response <> ''"
    return calls.groupBy("prompt_id").agg(
        F.expr(f"min_by(call_id, {order}) FILTER (WHERE {good})").alias("call_id"),
        F.expr(f"min_by(response, {order}) FILTER (WHERE {good})").alias("response"),
        F.expr(f"max_by(coalesce(error, 'empty response'), {order}) FILTER (WHERE NOT ({good}))").alias("last_error"),
    ).withColumn("last_error", F.when(F.col("call_id").isNull(), F.col("last_error")))


def call_spacing(calls: DataFrame, least: float = SPACING_S, parts: int | None = None) -> DataFrame:
    """gap_s since the previous call of the key, and whether it is too short. Few keys have all calls, so neighbours are found by ranges."""
    rows = with_previous(calls.select("key_id", "call_id", "ts"), ["key_id"], ["ts", "call_id"], "ts", parts)
    gap = (micros("ts") - micros("before")) / 1e6
    return rows.select("key_id", "call_id", gap.alias("gap_s"), F.coalesce(gap < least, F.lit(False)).alias("too_close"))


def round_robin(prompts: DataFrame, n_keys: int, within: str, parts: int | None = None) -> DataFrame:
    """Deal prompts to keys in turn, within each batch given by a column (a corpus has no single order)."""
    rows = numbered(prompts, [within], ["prompt_id"], parts).withColumn("dealt_key", F.pmod(F.col("rn") - 1, F.lit(n_keys)).cast("int"))
    return rows.select(*prompts.columns, "dealt_key")


def fanout_progress(calls: DataFrame, parts: int | None = None) -> DataFrame:
    """Progress of a key's batch after each call: 20 + 70 shares, and 55 + 45 shares, rounded down."""
    rows = numbered(calls.select("key_id", "call_id"), ["key_id"], ["call_id"], parts)
    share = lambda first, by: (F.floor(F.col("rn") * by / F.col("total")) + first).cast("int")
    return rows.select("key_id", "call_id", share(20, 70).alias("transcribe_pct"), share(55, 45).alias("structurize_pct"))


def call_rate(calls: DataFrame, window: str = RATE_WINDOW, slide: str | None = None, rate: int = RATE) -> DataFrame:
    """Calls by key and time window, and whether they exceed the rate. ts must be a timestamp."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = calls.groupBy("key_id", span.alias("span")).agg(F.count(F.lit(1)).alias("n_calls"))
    return rows.select("key_id", F.col("span.start").alias("window_start"), "n_calls", (F.col("n_calls") > rate).alias("over"))


def block_marks(calls: DataFrame) -> DataFrame:
    """(key_id, ts): attempts of a prompt on a key whose every model was rate-limited block the key at the last of them."""
    hit = F.coalesce(~F.col("ok") & (s.error_class(F.col("error")) == "rate_limit"), F.lit(False))
    return calls.groupBy("prompt_id", "attempt", "key_id").agg(F.bool_and(hit).alias("all_hit"), F.max("ts").alias("ts")).filter("all_hit").select("key_id", "ts")


def error_marks(calls: DataFrame) -> DataFrame:
    """(key_id, ts): calls that were rate-limited or overloaded, which block in transcription."""
    return calls.filter(s.error_class(F.col("error")).isin("rate_limit", "overload")).select("key_id", "ts")


def block_intervals(marks: DataFrame, gap: str = GAP) -> DataFrame:
    """Intervals [first mark, last mark + gap): a mark within the gap, or just at its end, extends the block."""
    span = F.session_window("ts", gap)
    rows = marks.groupBy("key_id", span.alias("span")).agg(F.count(F.lit(1)).alias("n_marks"))
    return rows.select("key_id", F.col("span.start").alias("block_start"), F.col("span.end").alias("block_end"), "n_marks")


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _points(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """All calls, block starts and block ends as points in time: at, turn (a call comes after what starts or ends at its instant)."""
    no = lambda kind: F.lit(None).cast(kind)
    asked = calls.select(micros("ts").alias("at"), F.lit(1).alias("turn"), "call_id", F.lit(0).alias("step"), no(blocks.schema["key_id"].dataType).alias("key_id"), no("long").alias("lo"), no("long").alias("hi"))
    span = ("key_id", micros("block_start").alias("lo"), micros("block_end").alias("hi"))
    ends = blocks.select(*span).filter("lo < hi").select(F.inline(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("step")))), "key_id", "lo", "hi")
    return asked.unionByName(ends.select("at", F.lit(0).alias("turn"), no(calls.schema["call_id"].dataType).alias("call_id"), "step", "key_id", "lo", "hi"))


def blocked_at(calls: DataFrame, blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """(call_id, blocked_key): which keys are inside a block [start, end) at the time of each call.

    Calls and the ends of blocks are cut into stretches of time of about equal rows; a block goes to the stretches from its
    start to its end, and meets the calls there.
    """
    rows = stretches(_points(calls, blocks), ["at", "turn"], parts)
    reach = rows.filter("turn = 0").groupBy("key_id", "lo", "hi").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    spans = reach.select("key_id", "lo", "hi", F.explode(F.sequence("a", "b")).alias("part"))
    inside = (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    return rows.filter("turn = 1").select("part", "at", "call_id").join(spans, "part").filter(inside).select("call_id", F.col("key_id").alias("blocked_key"))


def alive_keys(calls: DataFrame, blocks: DataFrame, n_keys: int, parts: int | None = None) -> DataFrame:
    """Number of keys that aren't blocked at the time of each call, by a sweep over time: starts of blocks count 1, ends -1.
    blocks: of one key disjoint, as block_intervals() gives them."""
    points = running_sum(_points(calls, blocks).select("at", "turn", "call_id", "step"), ["at", "turn"], "step", parts)
    return points.filter("turn = 1").select("call_id", (F.lit(n_keys) - F.col("running")).alias("alive"))


def key_wait(calls: DataFrame, blocks: DataFrame, interval_s: float = SPACING_S) -> DataFrame:
    """By key at the log's end: when it can be used again, from its last block and last call; and the least wait over the keys."""
    last = calls.groupBy("key_id").agg((F.max(micros("ts")) / 1e6 + interval_s).alias("ready"))
    until = blocks.groupBy("key_id").agg((F.max(micros("block_end")) / 1e6).alias("until"))
    now = calls.agg((F.max(micros("ts")) / 1e6).alias("now"))
    rows = last.join(until, "key_id", "left").crossJoin(F.broadcast(now))  # now: one row
    return rows.select("key_id", F.round(F.greatest(F.lit(0.0), F.greatest(F.col("ready"), F.coalesce("until", F.lit(0.0))) - F.col("now")), 6).alias("wait_s"))


def low_spans(rows: DataFrame, bound: float) -> DataFrame:
    """Runs of consecutive values under a bound: (task_id, first_seq, last_seq, n)."""
    w = Window.partitionBy("task_id").orderBy("seq")
    low = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("value") < bound)
    low = low.withColumn("island", F.col("rn") - F.row_number().over(w))
    return low.groupBy("task_id", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n")).drop("island")
