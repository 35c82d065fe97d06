"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each the shortest string not yet in the text's
own dictionary). The phrases' hashes form a set, and its KEPT smallest 32-bit hashes are the fingerprint,
in hexadecimal. The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets,
which is high where texts compress each other.

For the comparison with an edited text, documents are sorted over range partitions and streamed; each
task sees the next document of all but its last one. The first and last documents of the partitions
(two per partition) are matched in a second small step.

Defined results: null text is empty, has the empty fingerprint and likeness 1 with another empty text,
else 0; rows of equal (or null, which come first) id are ordered by a hash of their text; a single
document is followed by itself; empty tables give empty results; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.llm.common import slices, stored, table

KEPT = 64
_MASK = (1 << 60) - 1
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
ENDS = "part int, head boolean, tail boolean, text string"


def parse(data: bytes, trie: dict[int, int], hashes: list[int], node: int = 0) -> int:
    """Go on parsing: add data's new phrases to trie and their hashes to hashes; the node where it ends."""
    get, add = trie.get, hashes.append
    for b in data:
        key = node << 8 | b
        found = get(key)
        if found is None:
            trie[key] = len(hashes)
            add((hashes[node] * 1000003 ^ b + 1) & _MASK)
            node = 0
        else:
            node = found
    return node


def sketch(hashes: list[int], kept: int = KEPT) -> np.ndarray:
    """The smallest distinct 32-bit values of the phrases' hashes (the first is of the empty phrase)."""
    x = np.array(hashes[1:], np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    if len(x) > 2 * kept:
        few = np.unique(np.partition(x, 2 * kept)[: 2 * kept])
        x = few if len(few) >= kept else x
    return np.unique(x)[:kept].astype(">u4")


def sketches(text: str, other: str) -> tuple[np.ndarray, np.ndarray, str]:
    """The sketch of a text, that of the text with its last half replaced by other's beginning, and that edited text."""
    half = len(text) // 2
    first, rest, put = text[: len(text) - half], text[len(text) - half :], other[:half]
    trie: dict[int, int] = {}
    hashes = [0x2545F4914F6CDD1D & _MASK]
    node = parse(first.encode(), trie, hashes)
    n = len(hashes)
    parse(rest.encode(), trie, hashes, node)
    whole = sketch(hashes)
    del hashes[n:]
    while len(trie) >= n:  # back to the dictionary of the first half
        trie.popitem()
    parse(put.encode(), trie, hashes, node)
    return whole, sketch(hashes), first + put


def likeness(x: np.ndarray, y: np.ndarray, kept: int = KEPT) -> float:
    """The estimated Jaccard similarity: the share of the smallest values of both that both have."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    values, seen = np.unique(np.concatenate([x, y]), return_counts=True)
    return float((seen[:kept] == 2).mean())


def _row(doc_id, text: str, other: str, following: np.ndarray | None) -> tuple:
    own, edited, edited_text = sketches(text, other)
    return (
        doc_id, len(text), sha256(edited_text.encode()).hexdigest(), own.tobytes().hex(), edited.tobytes().hex(),
        likeness(own, edited), None if following is None else likeness(own, following), own,
    )


def _batch(rows: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in f"{OUT}, {ENDS}".split(", ")]
    whole = [(*r[:7], *e) for r, e in zip(rows, ends, strict=True)]
    columns = zip(*whole, strict=True) if whole else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition. The ends of the partition carry their text; its last row has no results yet."""
    part = TaskContext.get().partitionId()
    held, ready, head, rows, size = None, None, None, [], 0
    for piece in (x for batch in batches for x in slices(batch, 1, 1_000_000)):
        for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            text = text or ""
            if held is None:
                head = (doc_id, text)
            else:
                row = _row(*held, text, None)
                if ready is not None:
                    rows.append((*ready[:6], likeness(ready[7], row[7])))
                ready = row
                size += len(text)
            held = (doc_id, text)
            if size > 1_000_000:
                yield _batch(rows, [(None, False, False, None)] * len(rows))
                rows, size = [], 0
    if held is None:
        return
    if ready is not None:
        rows.append((*ready[:6], likeness(ready[7], sketches(held[1], "")[0])))
    yield _batch(rows, [(None, False, False, None)] * len(rows))
    blank = [(x[0], None, None, None, None, None, None) for x in (head, held)]
    yield _batch(blank, [(part, True, False, head[1]), (part, False, True, held[1])])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (x for batch in batches for x in slices(batch, 1, 1_000_000)):
        rows = []
        for doc_id, text, other in zip(*(c.to_pylist() for c in piece.columns), strict=True):
            rows.append(_row(doc_id, text, other, sketches(other, "")[0]))
        yield _batch(rows, [(None, False, False, None)] * len(rows)).select([x.split()[0] for x in OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    done = stored(rows.mapInArrow(_stream, f"{OUT}, {ENDS}"), "fingerprints")
    names = [x.split()[0] for x in OUT.split(", ")]
    heads = done.filter("head").select("part", F.col("text").alias("other"))
    turns = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))  # one row per partition
    first = heads.agg(F.min("part").alias("first"))
    turns = turns.join(F.broadcast(first)).select("part", F.coalesce("next", "first").alias("next"))  # one row more
    tails = done.filter("tail").select("doc_id", "text", "part").join(turns, "part")
    tails = tails.join(heads.select(F.col("part").alias("next"), "other"), "next").select("doc_id", "text", "other")
    return done.filter("NOT head AND NOT tail").select(names).unionByName(tails.mapInArrow(_ends, OUT))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
