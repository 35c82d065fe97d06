"""Column expressions for timecodes, names, texts and numbers. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text formats.
TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
BLOCK_TIMES = r"(\d{2}:\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[.,]\d{3})"
TIME_LINE = r"(?md)^\s*\d{2}:\d{2}:\d{2}[,.:]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.:]\d{3}.*$"
SECTION_TIMES = r"\[[0-9]{2}:[0-9]{2}:[0-9]{2}\s*-\s*[0-9]{2}:[0-9]{2}:[0-9]{2}\]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_tc(c: Column) -> Column:
    """Seconds of H:M:S, M:S or S, with a comma or point before the fraction; null if it is none of these."""
    p = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    whole = lambda i: F.get(p, F.lit(i)).try_cast("int").cast("double")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return (
        F.when(F.size(p) == 3, whole(0) * 3600 + whole(1) * 60 + part(2))
        .when(F.size(p) == 2, whole(0) * 60 + part(1))
        .otherwise(part(0))
    )


def _two(c: Column, width: int = 2) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def format_tc(seconds: Column, point: str = ",") -> Column:
    """HH:MM:SS,mmm, not below zero, milliseconds rounded half to even, hours as long as they are."""
    ms = F.greatest(F.lit(0).cast("long"), F.rint(seconds * 1000).cast("long"))
    part = lambda by, of: F.floor(ms / by).cast("long") % of if of else F.floor(ms / by).cast("long")
    return F.concat(
        _two(part(3_600_000, 0)), F.lit(":"), _two(part(60_000, 60)), F.lit(":"), _two(part(1000, 60)), F.lit(point), _two(ms % 1000, 3)
    )


def cut_tc(c: Column) -> Column:
    """A timecode as a cutting tool takes it: HH:MM:SS.mmm."""
    return format_tc(parse_tc(c), ".")


def trunc_tc(c: Column) -> Column:
    """A timecode without its fraction."""
    return F.substring_index(F.substring_index(c, ",", 1), ".", 1)


def slugify(c: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-zа-я0-9\-]", ""), r"-+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def numbered(prefix: str, number: Column, suffix: Column | str) -> Column:
    tail = suffix if isinstance(suffix, Column) else F.lit(suffix)
    return F.concat(F.lit(prefix), _two(number), tail)


def audio_name(number: Column, title: Column) -> Column:
    return numbered("", number, F.concat(F.lit("-"), slugify(title), F.lit(".mp3")))


def cut_name(number: Column) -> Column:
    return numbered("section_", number, ".mp3")


def slide_name(number: Column) -> Column:
    return numbered("slide-", number, ".png")


def strip_fence(c: Column) -> Column:
    """Trimmed text; if it begins with a code fence, without all lines that begin with one."""
    text = strip(c)
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.startswith("```"))
    return F.when(text.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(text)


def clean_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?md)^#{1,6}\s*", "")
    c = F.regexp_replace(c, r"(?md)^---\s*$", " ")
    c = F.regexp_replace(c, SECTION_TIMES, " ")
    return F.regexp_replace(c, r"[*_`>#]+", " ")


def clean_source(c: Column) -> Column:
    c = F.regexp_replace(c, TIME_LINE, " ")
    c = F.regexp_replace(c, r"(?md)^\s*\d+\s*$", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Words, lower-cased after they are found (lower-casing first would find others)."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def n_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def sentences(c: Column) -> Column:
    """Distinct normalised sentences: the words of each, with a space between. Words are taken out, because replacing all between them
    costs several times as much."""
    words = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), " ")
    parts = F.transform(F.split(F.lower(c), r"(?U)(?<=[.!?])\s+"), words)
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f has it."""
    return F.transform(F.array(value), f)[0]


def grams(c: Column, n: int) -> Column:
    """The n-grams of a list of tokens, with spaces between; none if there are fewer than n tokens."""
    if n == 1:
        return c
    part = lambda t, k: F.slice(t, F.lit(k + 1), F.greatest(F.lit(0), F.size(t) - (n - 1)))
    if n == 2:
        return let(c, lambda t: F.zip_with(part(t, 0), part(t, 1), lambda x, y: F.concat(x, F.lit(" "), y)))
    return let(c, lambda t: F.transform(part(t, 0), lambda _, i: F.array_join(F.slice(t, i + 1, F.lit(n)), " ")))


def counted(c: Column) -> Column:
    """(gram, cnt) of each distinct string of a list. Sorted in its row, so nothing is shuffled."""

    def of(x: Column) -> Column:
        begins = F.filter(F.transform(x, lambda g, i: F.when((i == 0) | (F.get(x, i - 1) != g), i)), F.isnotnull)
        ends = lambda b: F.concat(F.slice(b, F.lit(2), F.size(b)), F.slice(F.array(F.size(x)), F.lit(1), F.size(b)))
        entry = lambda a, b: F.struct(F.get(x, a).alias("gram"), (b - a).cast("long").alias("cnt"))
        return let(begins, lambda b: F.zip_with(b, ends(b), entry))

    return let(F.sort_array(c), of)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return safe_div(precision * recall * 2, precision + recall)


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: s != "")


def backoff(attempt: Column) -> Column:
    """Seconds to wait after a timeout: 5, 10, 20, ..."""
    return (F.pow(F.lit(2.0), attempt) * 5).cast("long")


def linear_backoff(attempt: Column) -> Column:
    return ((attempt + 1) * 10).cast("long")


def media_type(path: Column) -> Column:
    """pdf or pptx by the lower-cased suffix, else unsupported."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".pptx", "pptx").otherwise("unsupported")


def plain_lines(c: Column) -> Column:
    """The text lines of SRT: trimmed, without blank, all-digit and time lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.rlike(r"^\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->"))


def plain_text(c: Column) -> Column:
    return F.array_join(plain_lines(c), " ")


def error_class(message: Column) -> Column:
    m = F.upper(message)
    return (
        F.when(m.contains("429") | m.contains("RESOURCE_EXHAUSTED"), "rate_limit")
        .when(m.contains("503") | m.contains("UNAVAILABLE"), "overload")
        .otherwise("fatal")
    )


def http_action(status: Column, attempt: Column, last: int = 4) -> Column:
    """What follows an HTTP outcome (status null: a timeout): done, backoff, block or fatal."""
    return (
        F.when(status == 200, "done")
        .when(attempt >= last, "fatal")
        .when(status.isNull() | (status == 524), "backoff")
        .when(status.isin(429, 503), "block")
        .otherwise("fatal")
    )


def stage_progress(stage: Column, pct: Column) -> Column:
    """Progress of a whole task from that of its stage."""
    p = pct.cast("double")
    div = lambda n: F.floor(p / n).cast("int")
    return (
        F.when(stage == "transcribe", F.least(F.lit(20), div(5)))
        .when(stage == "slides", div(5) + 20)
        .when(stage == "structurize", div(3) + 45)
        .when(stage == "audio_cut", F.lit(80))
        .when(stage == "export", F.lit(90))
    )


def status_label(stage: Column, pct: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in STAGE_LABELS.items() for x in pair))
    name = F.coalesce(F.try_element_at(known, stage), F.nullif(stage, F.lit("")), F.lit(WAITING))
    return F.concat(F.lit("⏳ "), name, F.lit("... "), F.coalesce(pct, F.lit(0)).cast("string"), F.lit("%"))


# What each stage is called, and a task that has none yet.
STAGE_LABELS = {
    "transcribe": "Транскрибация",
    "slides": "Обработка слайдов",
    "structurize": "Структурирование",
    "audio_cut": "Нарезка аудио",
    "export": "Сборка результата",
}
WAITING = "Ожидание"
