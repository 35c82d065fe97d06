import random
from collections import defaultdict
from hashlib import sha1

import pytest

from noteloom.llm import warc
from noteloom.llm.common import new_path


def back(spark, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = new_path(spark, "warc-test")
    return warc.resolve(warc.read_warc(warc.write_warc(pages, folder, **kw), folder)).collect()


def test_round_trip_with_magic_in_payloads(spark):
    fake = warc.record(99, "http://x/", b"y" * 50, "0" * 40, None).decode()
    same = "same " * 400
    rows = [(1, "http://a/", fake, None), (2, "u\r\nWARC-Type: x", "a" + fake * 3 + "WARC/1.1\r\n", "d"), (3, None, None, None), (4, "", "", None)]
    rows += [(5, "s", same, None), (9, "s", same, None), (7, "s", same, None), (8, "t", "short", None), (6, "t", "short", None), (None, "n", "null id", None)]
    rows += [(10, "long", "é" * 2_000_000, None), (11, "w", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", None)]
    for kw in ({}, {"file_bytes": 1}):
        got = back(spark, rows, **kw)
        assert len(got) == len(rows)
        groups = defaultdict(list)
        for r in rows:
            groups[r[2] or ""].append(r[0] or -1)
        by = {r.page_id: r for r in got}
        for page_id, _, html, _ in rows:
            r, b = by[page_id], (html or "").encode()
            m = max(groups[html or ""])
            again = len(b) >= 1000 and m != page_id
            assert (r.payload_bytes, r.payload_digest) == (len(b), sha1(b).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", m) if again else ("response", None))


def test_chain_skips_unreached_candidates(spark):
    rows = [("a", 0, 100), ("a", 40, 60), ("a", 60, 100), ("a", 100, 250), ("a", 250, 300), ("b", 5, 9)]
    found = spark.createDataFrame(rows, "file string, offset long, next long")
    assert sorted((r.file, r.offset) for r in warc.reachable(found).collect()) == [("a", 0), ("a", 100), ("a", 250)]


def test_forest_tells_who_passes_whom():
    pick = random.Random(4)
    for _ in range(200):
        offsets = sorted(pick.sample(range(1000), pick.randrange(1, 30)))
        following = [pick.choice([x for x in offsets if x > o] + [o + 1 + pick.randrange(2000), 5000]) for o in offsets]
        got = dict(zip(offsets, warc.forest(offsets, following), strict=True))
        step = dict(zip(offsets, following, strict=True))
        for o in offsets:
            path, at = [], o
            while at in step:
                path.append(at)
                at = step[at]
            assert got[o][0] == at
            assert [y for y in offsets if got[y][1] <= got[o][1] <= got[y][2]] == path


def test_magic_at_the_last_byte_of_a_range_and_long_url_across_it(spark):
    edge = warc.RANGE_BYTES
    first = len(warc.record(1, "a", b"", "0" * 40, None))
    for near in (0, 1, 5, len(warc.MAGIC)):
        pad = "x" * (edge - first - near - 7)  # the length of the payload is written twice
        rows = [(1, "a", pad, None), (2, "u" * 100_000, "second", None), (3, "c", "third", None)]
        got = {r.page_id: r.payload_bytes for r in back(spark, rows, file_bytes=1 << 30)}
        assert got == {1: len(pad), 2: 6, 3: 5}


def test_torn_archive_is_an_error(spark):
    folder = new_path(spark, "warc-torn")
    pages = spark.createDataFrame([(k, "u", "y" * 5000 + str(k), None) for k in range(9)], "page_id long, url string, html string, digest string").coalesce(1)
    archives = warc.write_warc(pages, folder)
    fs, base = warc.opened(folder)
    name = archives.first().file
    data = fs.open_input_file(f"{base}/{name}").read()
    second = data.index(warc.MAGIC, 1)
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(data[:second] + b"WARC/0.1\r\n" + data[second + len(warc.MAGIC) :])
    with pytest.raises(ValueError, match="chain of records"):
        warc.read_warc(archives, folder).count()


def test_empty(spark):
    assert back(spark, []) == []


def test_long_urls(spark):
    """Headers that go on beyond what a range holds: none of their records, nor of those after them, is lost."""
    rows = [(1, "a", "x" * (warc.RANGE_BYTES - 1000), None), (2, "u" * 200_000, "second", None), (3, "v" * 3_000_000, "third", None), (4, "b", "fourth", None)]
    got = {r.page_id: r for r in back(spark, rows, file_bytes=1 << 30)}
    assert sorted(got) == [1, 2, 3, 4]
    assert all(got[k].payload_digest == sha1(html.encode()).hexdigest() for k, _, html, _ in rows)
