"""WARC archives written and read back by Spark tasks, with boundary-chain verification.

Writing: each task writes archives of bounded size to the shared folder and reports them; only reported
archives count, so a task that is run again leaves no wrong records. Equal payloads of at least
`REVISIT_BYTES` bytes are written once, by the page with the largest id; the others become revisit records.

Reading: archives are cut into ranges. Each task looks for the magic in its range and emits every
candidate record with the offset its Content-Length leads to. Only candidates that the chain from the
file's start reaches are records, so magic inside payloads is rejected. Chains are resolved within a range by its
task: a candidate knows where its chain leaves the range, and its place in the range's forest of chains. From range to
range the chain is followed for all files at once by pointer jumping: in round k the reached candidates
mark those 2^k ranges further on. A chain that does not end where its file ends is an error, never a loss of records.

Defined results: null html is an empty payload; null page_id stays null; repeated rows are written one by
one, and rows that share the largest page_id of a group of equal payloads are all responses; empty
tables give empty results; further columns aren't looked at. Line breaks in a url become blanks; a url may
have any length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import new_path, stored, table

REVISIT_BYTES = 1000
FILE_BYTES = 4 << 20
RANGE_BYTES = 1 << 20
HEADER_BYTES = 64 << 10  # how much is read at first beyond a range; longer headers are read on
# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FOUND = (
    "file string, offset long, next long, type string, page_id long, refers_to long, payload_bytes long, "
    "payload_digest string, said_digest string, begin long, exit long, first long, last long"
)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit carries the headers of its block only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc", 0
                    out = fs.open_output_stream(f"{base}/{name}")
                data = record(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "bytes"])

    return write


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and refers_to for those pages that revisit another's payload.

    Payloads don't move for this: pages are grouped by digests, and the table of revisits joins by
    broadcast only if Spark sees from its files that it is small.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.sha1(payload).alias("digest"),
        F.sha2(payload, 256).alias("exact"), F.octet_length(payload).alias("n"),
    )
    large = rows.filter(F.col("n") >= REVISIT_BYTES)
    groups = large.groupBy("exact").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    revisits = large.select("page_id", "exact").join(groups, "exact").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = stored(revisits.select(F.col("page_id").alias("of"), F.col("exact").alias("as"), "refers_to").distinct(), "revisits")
    return rows.join(revisits, rows["page_id"].eqNullSafe(revisits["of"]) & (rows["exact"] == revisits["as"]), "left").select(
        "page_id", "url", "html", "digest", "refers_to"
    )


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives into folder; the table of archives (file, bytes)."""
    return stored(plan_records(pages).mapInArrow(_writer(folder, file_bytes), "file string, bytes long"), "archives")


def parse(head: bytes) -> dict[bytes, bytes] | None:
    """The named fields after the magic, if they are a header block with a length."""
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon or b" " in name:
            return None
        fields[name.lower()] = value
    return fields if fields.get(b"content-length", b"").isdigit() else None


def _number(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def forest(offsets: list[int], following: list[int]) -> list[tuple[int, int, int]]:
    """Of a range's candidates in order: where their chain leaves the range, and numbers such that the chain of x passes y
    exactly if first(y) <= first(x) <= last(y)."""
    place = {x: k for k, x in enumerate(offsets)}
    up = [place.get(x, -1) for x in following]
    below = [1] * len(up)
    for k, p in enumerate(up):  # a chain only leads onward, so what leads to a candidate comes before it
        if p >= 0:
            below[p] += below[k]
    leave, first, free, roots = list(following), [0] * len(up), [0] * len(up), 0
    for k in range(len(up) - 1, -1, -1):
        p = up[k]
        if p >= 0:
            leave[k], first[k] = leave[p], free[p]
            free[p] += below[k]
        else:
            first[k] = roots
            roots += below[k]
        free[k] = first[k] + 1
    return [(x, a, a + n - 1) for x, a, n in zip(leave, first, below, strict=True)]


def _scanner(folder: str):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        for batch in batches:
            rows = []
            for name, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = len(rows)
                with fs.open_input_file(f"{base}/{name}") as f:
                    end = min(size, begin + RANGE_BYTES)
                    held = f.read_at(min(size, end + HEADER_BYTES) - begin, begin)
                    at, stop = held.find(MAGIC), held.find(b"\r\n\r\n")
                    while 0 <= at < end - begin:
                        if 0 <= stop < at:
                            stop = held.find(b"\r\n\r\n", at)
                        while stop < 0 and begin + len(held) < size:  # a header may be longer than what is held
                            tail = max(at, len(held) - 3)
                            held += f.read_at(min(size - begin - len(held), RANGE_BYTES), begin + len(held))
                            stop = held.find(b"\r\n\r\n", tail)
                        fields = parse(held[at + len(MAGIC) : stop]) if stop >= 0 else None
                        if fields is not None:
                            first, n = begin + stop + 4, int(fields[b"content-length"])
                            block = held[stop + 4 : stop + 4 + n] if first + n <= begin + len(held) else f.read_at(n, first) if first + n <= size else b""
                            payload = block.partition(b"\r\n\r\n")[2]
                            rows.append((
                                name, begin + at, first + n + 4, fields.get(b"warc-type", b"").decode("latin-1"), _number(fields.get(b"warc-record-id")),
                                _number(fields.get(b"warc-refers-to")), len(payload), sha1(payload).hexdigest(),
                                fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1"),
                            ))
                        at = held.find(MAGIC, at + 1)
                own = rows[head:]
                rows[head:] = [(*r, begin, *x) for r, x in zip(own, forest([r[1] for r in own], [r[2] for r in own]), strict=True)]
            names = [x.split()[0] for x in FOUND.split(", ")]
            kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in FOUND.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return candidates


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from the start of their file, by pointer jumping."""
    links = candidates.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("reached"))
    links, known = stored(links, "links"), -1
    while (n := links.filter("reached").count()) > known:
        known = n
        marks = links.filter("reached").select("file", F.col("jump").alias("offset"), F.lit(True).alias("marked"))
        jumps = links.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        links = stored(
            links.join(marks, ["file", "offset"], "left")
            .join(jumps, ["file", "jump"], "left")
            .select("file", "offset", F.coalesce("further", F.lit(-1).cast("long")).alias("jump"), (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")),
            "links",
        )
    return links.filter("reached").select("file", "offset")


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives: file, offset, next, type, page_id, refers_to, payload_bytes, payload_digest, said_digest."""
    spans = archives.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("begin"))
    found = stored(spans.repartition("file", "begin").mapInArrow(_scanner(folder), FOUND), "candidates")
    links = found.select("file", "offset", F.col("exit").alias("next"))
    led = links.select("file", F.col("next").alias("offset")).distinct()
    heads = links.filter("offset = 0").unionByName(links.filter("offset > 0").join(led, ["file", "offset"], "left_semi"))  # where a chain may enter a range
    entered = reachable(heads).join(found.select("file", "offset", "begin", F.col("first").alias("entry"), "exit"), ["file", "offset"])
    entered = stored(entered.select("file", "begin", "entry", "exit"), "entries")
    ends = entered.groupBy("file").agg(F.max("exit").alias("end"))
    torn = archives.join(ends, "file", "left").filter(~F.col("bytes").eqNullSafe(F.col("end"))).first()
    if torn is not None:
        raise ValueError(f"{folder}/{torn.file}: its chain of records ends at {torn.end}, the file at {torn.bytes}")
    passed = (F.col("entry") >= F.col("first")) & (F.col("entry") <= F.col("last"))
    return found.join(entered.drop("exit"), ["file", "begin"]).filter(passed).drop("begin", "exit", "first", "last", "entry")


def resolve(records: DataFrame) -> DataFrame:
    """One row per page; a revisit has the size of the response it refers to, if that has the digest the revisit names."""
    full = records.filter("type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said_digest"), F.col("payload_bytes").alias("full_bytes")
    ).distinct()
    there = records.filter("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = records.filter("type = 'revisit'").join(full, ["refers_to", "said_digest"], "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("said_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"
    )
    return there.unionByName(again)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = write_warc(table(spark, sf_dir, "pages"), folder)
    return resolve(read_warc(archives, folder))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
     g AS (SELECT page_id, octet_length(b) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM g
"""
