"""Edge values of the column expressions, on literal tables."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import scalars as s


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "kind", "table"),
    [
        (s.parse_tc, "string", [("02:03:04,125", 7384.125), ("41:07,875", 2467.875), ("9.25", 9.25), ("120:00:30", 432030.0), ("x", None), (None, None), ("1:2:3:4", 1.0)]),
        (s.trunc_tc, "string", [("03:41:59,001", "03:41:59"), ("03:41:59.999", "03:41:59"), ("12:00:00", "12:00:00")]),
        (s.cut_tc, "string", [("07:08:09,010", "07:08:09.010"), ("00:59:30,000", "00:59:30.000"), ("44:01,25", "00:44:01.250")]),
        (s.format_tc, "double", [(-3.0, "00:00:00,000"), (0.0005, "00:00:00,000"), (0.0015, "00:00:00,002"), (5025.75, "01:23:45,750"), (442801.0, "123:00:01,000")]),
        (s.slugify, "string", [("Ряды  и Пределы?", "ряды-и-пределы"), ("Ёж é - x", "ж-x"), ("???", "section"), ("  A_b\tC ", "ab-c")]),
        (s.strip_fence, "string", [("```json\n[1]\n```", "[1]"), (" [2] ", "[2]"), ("a\n```", "a\n```")]),
        (s.error_class, "string", [("429 and 503", "rate_limit"), ("resource_exhausted", "rate_limit"), ("Unavailable", "overload"), ("x", "fatal")]),
        (s.media_type, "string", [("a/b.PDF", "pdf"), ("b.pptx", "pptx"), ("c.txt", "unsupported"), ("d", "unsupported")]),
        (s.clean_source, "string", [("8\n00:05:06,700 --> 00:05:09:100\nsome <i>set</i>  words\n", "some set words"), ("", "")]),
        (s.backoff, "int", [(0, 5), (1, 10), (4, 80)]),
        (s.linear_backoff, "int", [(0, 10), (2, 30)]),
    ],
)
def test_values(spark, f, kind, table):
    got = values(spark, f, [x for x, _ in table], kind)
    assert got == [y for _, y in table]


def test_tokens_and_sentences(spark):
    assert values(spark, s.tokens, ["Ab ё-é 12", "\u212a İ", ""]) == [["ab", "ё", "12"], [], []]
    assert values(spark, s.sentences, ["One two. one  TWO! Three? four"]) == [["one two", "three", "four"]]
    assert values(spark, s.csv_list, ["k1, k2 ,k3,, "]) == [["k1", "k2", "k3"]]


def test_plain_lines_drop_numbers_and_times(spark):
    srt = "5\n00:03:10,100 --> 00:03:12,900\nUpper\n\n6\n00:03:13,000 --> 00:03:15,250\n 77 \nLower"
    assert values(spark, s.plain_text, [srt]) == ["Upper Lower"]


def test_http_and_progress(spark):
    df = spark.createDataFrame([(200, 0), (524, 0), (None, 1), (429, 2), (503, 0), (500, 0), (524, 4)], "status int, attempt int")
    got = [r.a for r in df.select(s.http_action(F.col("status"), F.col("attempt")).alias("a")).collect()]
    assert got == ["done", "backoff", "backoff", "block", "block", "fatal", "fatal"]
    rows = spark.createDataFrame([("transcribe", 100), ("slides", 100), ("structurize", 99), (None, 3), ("odd", 1)], "stage string, pct int")
    got = [(r.p, r.t) for r in rows.select(s.stage_progress(F.col("stage"), F.col("pct")).alias("p"), s.status_label(F.col("stage"), F.col("pct")).alias("t")).collect()]
    assert [p for p, _ in got] == [20, 40, 78, None, None]
    assert got[0][1] == "⏳ Транскрибация... 100%" and got[3][1] == "⏳ Ожидание... 3%" and got[4][1] == "⏳ odd... 1%"
