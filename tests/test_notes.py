"""Library functions on lectures and notes, on literal tables."""

from pyspark.sql import functions as F

from noteloom.operators import events as ev
from noteloom.operators import notes as nt


def test_filters(spark):
    lectures = spark.createDataFrame([(1, "maths", 50), (2, "maths", 500), (3, "art", 900), (4, None, None)], "lecture_id int, subject string, n_chars int")
    tags = spark.createDataFrame([(1, "good"), (2, "good"), (2, "good"), (3, "poor"), (None, "good"), (4, "good")], "lecture_id int, tag string")
    ids = lambda **kw: sorted(r.lecture_id for r in nt.lecture_filter(lectures, tags=tags, **kw).collect())
    assert ids() == [1, 2, 3, 4] and ids(subject="maths") == [1, 2] and ids(tag="good") == [1, 2, 4]
    assert ids(tag="good", least_chars=50) == [2] and ids(subject="art", tag="good") == []


def test_versions_reviews_and_attempts(spark):
    rows = spark.createDataFrame([("a", "x", 1, 1), ("a", None, 3, 1), ("a", "y", 3, 0), ("b", "z", 2, 5)], "k string, title string, ts int, seq int")
    assert sorted(map(tuple, nt.latest_version(rows, "k", "title").collect())) == [("a", None, 3), ("b", "z", 2)]
    stars = spark.createDataFrame([("a", 5), ("a", 4), ("b", None)], "k string, stars int")
    assert sorted(map(tuple, nt.review_stats(stars, "k").collect())) == [("a", 2, 4.5), ("b", 1, None)]
    tries = spark.createDataFrame([(1, 1, 0, 10, 59.0), (1, 2, 0, 11, 60.0), (1, 3, 0, 12, 99.0), (2, 1, 0, 13, 1.0), (2, 2, 0, 14, 2.0)], "prompt_id int, attempt int, model_rank int, call_id int, score double")
    assert sorted(map(tuple, nt.qa_attempts(tries, 60).collect())) == [(1, 11, False), (2, 14, True)]


def test_photos(spark):
    photos = spark.createDataFrame([("L", 5.0, 1), ("L", 10.0, 2), ("L", 99.0, 3), ("M", 1.0, 4)], "lecture_id string, at double, photo_id int")
    sections = spark.createDataFrame([("L", 0, 10.0), ("L", 1, 20.0)], "lecture_id string, section_no int, start_s double")
    assert sorted(map(tuple, nt.photo_section_asof(photos, sections).collect())) == [(2, "L", 0), (3, "L", 1)]


def test_marks_only_where_every_model_was_rate_limited(spark):
    rows = [(1, 1, 0, "429"), (1, 1, 0, "resource_exhausted"), (2, 1, 0, "429"), (2, 1, 0, "503"), (3, 1, 1, "429"), (3, 1, 1, None), (3, 2, 1, "http 429")]
    calls = spark.createDataFrame([(p, a, k, e is None, e, f"2031-05-06 07:00:0{n}") for n, (p, a, k, e) in enumerate(rows)], "prompt_id int, attempt int, key_id int, ok boolean, error string, ts string")
    got = ev.block_marks(calls.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert sorted((r.key_id, str(r.ts)[-1]) for r in got) == [(0, "1"), (1, "6")]
