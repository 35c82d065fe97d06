"""Removal of repeated passages with a logarithmic family of suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier is removed. Strings that are equal
hold the same anchor, the leftmost of their GRAM-byte grams of least hash, at the same place; so the windows
of a text fall into runs that share an anchor, and only runs whose anchor's gram occurs twice can repeat.

Jobs: (1) tasks send the grams of their anchors, as packed numbers, to the owners of hash ranges, which
return those that occur twice. (2) Blocks of texts send their runs with such grams, each run's bytes once per
block, to the owners. (3) An owner takes runs in text order, batch by batch: a batch gets its suffix array,
is merge-scanned against the arrays of the existing levels, and levels of equal size are merged. First whole
runs are matched, so copies cost one entry; then the windows of those runs that share a gram but differ.
(4) Texts lose the spans found. Bytes themselves are compared, never hashes alone.

Order: smaller doc_id first (null before all), and among rows of one id an arbitrary fixed order; so of
repeated rows one counts as the earlier. Null text is empty; texts under LENGTH bytes stay whole; empty
tables give empty results; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import slices, stored, table

LENGTH = 100
GRAM = 32
SPREAD = LENGTH - GRAM + 1  # grams in a window, and the most windows in a run
WIDTH = LENGTH - 1 + SPREAD  # bytes of the longest run
SEGMENT = 400_000
BLOCK_BYTES = 8_000_000
BATCH = 1 << 14
RANGE = 1 << 13
_PLACE = np.uint64((1 << 24) - 1)
_Q = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0xD6E8FEB86659FD93)
    while width < GRAM:
        h = h[:-width] * base + h[width:]
        with np.errstate(over="ignore"):
            base = base * base
        width *= 2
    h ^= h >> np.uint64(31)
    h *= _Q
    h ^= h >> np.uint64(29)
    return h


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in texts laid end to end (ends: where each ends): gram hash, first window, number of windows."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPREAD:
        least = np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])
    starts = np.concatenate([[0], ends[:-1]])
    room = np.maximum(0, ends - starts - LENGTH + 1)
    inside = np.zeros(len(least) + 1, np.int64)
    np.add.at(inside, np.minimum(starts, len(least))[room > 0], 1)
    np.add.at(inside, np.minimum(starts + room, len(least))[room > 0], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    gram = h[anchor[new]]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)  # anchors have the least hashes; owners need even ones
    return gram, at[new], np.diff(np.concatenate([new, [len(at)]]))


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of bounded size: bytes, ends of the parts in them, each part's text and where it begins in that text.

    Parts of a long text overlap by LENGTH - 1 bytes, so each window is in one of them.
    """
    held, size = [], 0
    for k, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            part = text[begin : begin + SEGMENT + LENGTH - 1]
            if len(part) >= LENGTH:
                held.append((part, k, begin))
                size += len(part)
            if size >= SEGMENT:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
    return data, np.cumsum([len(x[0]) for x in held]), np.array([x[1] for x in held]), np.array([x[2] for x in held])


def _grams(owners: int):
    shift = np.uint64(64 - owners.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed grams (those met once, those met more often) by block and owner."""

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for block, found in held.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                owner = (g >> shift).astype(np.int64) if owners > 1 else np.zeros(len(g), np.int64)
                bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
                rows += [(block, int(owner[x]), g[x:y][n[x:y] == 1].tobytes(), g[x:y][n[x:y] > 1].tobytes()) for x, y in zip(bounds, bounds[1:], strict=False)]
            columns = zip(*rows, strict=True) if rows else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "owner", "once", "often"])

        held: dict[int, list] = {}
        size = 0
        for piece in (x for batch in batches for x in slices(batch, 1, BLOCK_BYTES)):
            texts = [(t or "").encode() for t in piece.column(1).to_pylist()]
            blocks = piece.column(0).to_numpy()
            for data, ends, which, _ in segments(texts):
                g, first, _ = runs_of(data, ends)
                of = blocks[which[np.searchsorted(ends, first, side="right")]]
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else []
                for x, part in zip(cuts, np.split(g[order], cuts[1:]) if len(of) else [], strict=True):
                    held.setdefault(int(of[order][x]), []).append(part)
                size += len(g)
            if size > 4_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


def _twice(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one owner: the grams of each block that occur twice anywhere."""
    once = [np.frombuffer(x, np.uint64) for x in pdf["once"]]
    often = [np.frombuffer(x, np.uint64) for x in pdf["often"]]
    g, n = np.unique(np.concatenate(once + often + often), return_counts=True)
    again = g[n > 1]
    rows = []
    for block, x, y in zip(pdf["block"], once, often, strict=True):
        at = np.minimum(np.searchsorted(again, x), max(0, len(again) - 1))
        found = np.concatenate([x[again[at] == x] if len(again) else x[:0], y])
        if len(found):
            rows.append((block, found.tobytes()))
    return pd.DataFrame(rows, columns=["block", "grams"]).astype({"block": "int64"})


def run_matrix(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes of runs, padded to WIDTH, and the number of windows."""
    at = first[:, None] + np.arange(WIDTH)
    out = np.zeros((len(first), WIDTH + 1), np.uint8)
    inside = np.arange(WIDTH) < (n + LENGTH - 1)[:, None]
    out[:, :WIDTH][inside] = data[at[inside]]
    out[:, WIDTH] = n
    return out


class Family:
    """Sorted arrays of byte strings, of sizes that grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Whether each string of the batch was in an earlier batch, or earlier in this one; the new ones are kept."""
        order = np.argsort(batch, kind="stable")
        keys = batch[order]
        old = np.concatenate([[False], keys[1:] == keys[:-1]])
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            old |= level[at] == keys
        seen = np.zeros(len(batch), bool)
        seen[order] = old
        fresh = keys[~old]
        if len(fresh):
            while self.levels and len(self.levels[-1]) <= 2 * len(fresh):
                fresh = np.sort(np.concatenate([self.levels.pop(), fresh]), kind="stable")
            self.levels.append(fresh)
        return seen


OUT = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _block_runs(owners: int):
    shift = np.uint64(64 - owners.bit_length() + 1)
    names = [*(x.split()[0] for x in OUT.split(", ")), "block", "row", "text", "owner", "runs", "bytes", "spans"]

    def run(docs: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        """For one block: results of texts without repeated grams, the other texts, and packed runs for the owners."""
        if not len(docs):
            return pd.DataFrame(columns=names)
        docs = docs.sort_values(["doc_id", "no_id", "text"], ignore_index=True)
        block = int(docs["block"].iloc[0])
        texts = [x.encode() for x in docs["text"]]
        again = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in grams["grams"])]))
        ids = np.where(docs["no_id"], np.iinfo(np.int64).min, docs["doc_id"].to_numpy(np.int64))
        heads, bodies, hashes = [], [], []
        for data, ends, which, begin in segments(texts) if len(again) else ():
            g, first, n = runs_of(data, ends)
            known = again[np.minimum(np.searchsorted(again, g), len(again) - 1)] == g
            g, first, n = g[known], first[known], n[known]
            part = np.searchsorted(ends, first, side="right")
            row = which[part]
            start = first - np.concatenate([[0], ends[:-1]])[part] + begin[part]
            heads.append(np.column_stack([ids[row], row, start, n]))
            bodies.append(run_matrix(data, first, n))
            hashes.append(g)
        blank = dict.fromkeys(names)
        out = []
        pending: set[int] = set()
        if heads and sum(map(len, heads)):
            head, body, g = np.concatenate(heads), np.concatenate(bodies), np.concatenate(hashes)
            pending = set(head[:, 1].tolist())
            order = np.lexsort((head[:, 2], head[:, 1], head[:, 0]))
            head, body, g = head[order], body[order], g[order]
            seen = np.zeros(len(head), bool)
            family, keys = Family(), np.ascontiguousarray(body).view(f"S{WIDTH + 1}").ravel()
            for k in range(0, len(keys), BATCH):
                seen[k : k + BATCH] = family.add(keys[k : k + BATCH])
            gone = head[seen]
            if len(gone):
                out.append(blank | {"block": block, "spans": np.column_stack([gone[:, 1], gone[:, 2], gone[:, 2] + gone[:, 3] + LENGTH - 1]).tobytes()})
            head, body, g = head[~seen], body[~seen], g[~seen]
            owner = (g >> shift).astype(np.int64) if owners > 1 else np.zeros(len(g), np.int64)
            order = np.argsort(owner, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                inside = np.arange(WIDTH) < (head[part, 3] + LENGTH - 1)[:, None]
                packed = zstandard.ZstdCompressor(level=1).compress(body[part][:, :WIDTH][inside].tobytes())
                runs = np.ascontiguousarray(np.column_stack([head[part], g[part].view(np.int64)]).T)
                runs = zstandard.ZstdCompressor(level=1).compress(runs.tobytes())
                out.append(blank | {"block": block, "owner": int(owner[part[0]]), "runs": runs, "bytes": packed})
        for row, (doc_id, no_id, text, whole) in enumerate(zip(docs["doc_id"], docs["no_id"], docs["text"], texts, strict=True)):
            if row in pending:
                out.append(blank | {"doc_id": doc_id, "no_id": no_id, "block": block, "row": row, "text": text})
            else:
                out.append(blank | {"doc_id": doc_id, "no_id": no_id, "n_bytes": len(whole), "n_removed": 0, "n_spans": 0, "kept_sha256": sha256(whole).hexdigest()})
        return pd.DataFrame(out, columns=names, dtype=object)

    return run


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one owner: the spans to remove, packed for each block."""
    heads, bodies = [], []
    for block, runs, packed in zip(pdf["block"], pdf["runs"], pdf["bytes"], strict=True):
        head = np.frombuffer(zstandard.ZstdDecompressor().decompress(runs), np.int64).reshape(5, -1).T
        body = np.zeros((len(head), WIDTH + 1), np.uint8)
        inside = np.arange(WIDTH) < (head[:, 3] + LENGTH - 1)[:, None]
        body[:, :WIDTH][inside] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        body[:, WIDTH] = head[:, 3]
        heads.append(np.column_stack([head, np.full(len(head), int(block))]))
        bodies.append(body)
    head, body = np.concatenate(heads), np.concatenate(bodies)
    order = np.argsort(head[:, 4], kind="stable")
    gram, spans = head[order, 4], []
    begin = 0
    while begin < len(order):  # a range of grams at a time, so that little is held
        end = int(np.searchsorted(gram, gram[min(begin + RANGE, len(order) - 1)], side="right"))
        part = order[begin:end]
        part = part[np.lexsort((head[part, 2], head[part, 1], head[part, 5], head[part, 0]))]
        spans += _match(head[part], body[part])
        begin = end
    found = np.concatenate(spans)
    rows = [(int(b), found[found[:, 0] == b][:, 1:].tobytes()) for b in np.unique(found[:, 0])]
    return pd.DataFrame(rows, columns=["block", "spans"]).astype({"block": "int64"})


def _match(head: np.ndarray, body: np.ndarray) -> list[np.ndarray]:
    """Spans (block, row, begin, end) of runs in text order that repeat, wholly or in some windows."""
    seen = np.zeros(len(head), bool)
    family, keys = Family(), np.ascontiguousarray(body).view(f"S{WIDTH + 1}").ravel()
    for k in range(0, len(keys), BATCH):
        seen[k : k + BATCH] = family.add(keys[k : k + BATCH])
    spans = [np.column_stack([head[seen][:, [5, 1, 2]], head[seen][:, 2] + head[seen][:, 3] + LENGTH - 1])]
    _, at, n = np.unique(head[~seen][:, 4], return_inverse=True, return_counts=True)
    left = np.flatnonzero(~seen)[n[at] > 1]
    family = Family()
    size = max(1, BATCH // 32)
    for k in range(0, len(left), size):
        some = left[k : k + size]
        of = np.repeat(some, head[some, 3])
        offset = np.arange(len(of)) - np.repeat(np.cumsum(head[some, 3]) - head[some, 3], head[some, 3])
        strings = body[of[:, None], offset[:, None] + np.arange(LENGTH)]
        old = np.flatnonzero(family.add(np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()))
        if len(old):
            new = np.concatenate([[True], (np.diff(old) > 1) | (np.diff(of[old]) != 0)])
            last = np.concatenate([new[1:], [True]])
            x, y = old[new], old[last]
            spans.append(np.column_stack([head[of[x]][:, [5, 1, 2]], head[of[y], 2]]))
            spans[-1][:, 2] += offset[x]
            spans[-1][:, 3] += offset[y] + LENGTH
    return spans


def _remove(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """For one block: texts without their spans."""
    found = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 3) for x in spans["spans"])])
    found = found[np.argsort(found[:, 0], kind="stable")]
    out = []
    for doc_id, no_id, row, text in zip(docs["doc_id"], docs["no_id"], docs["row"], docs["text"], strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        x, y = np.searchsorted(found[:, 0], [row, row + 1])
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, found[x:y, 1], 1)
        np.add.at(change, found[x:y, 2], -1)
        gone = np.cumsum(change[:-1]) > 0
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, no_id, len(data), int(gone.sum()), n_spans, sha256(data[~gone].tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def passage_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    owners = 1 << max(0, (blocks - 1).bit_length())
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("no_id"), text.alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
    )
    sent = rows.select("block", "text").mapInArrow(_grams(owners), "block long, owner long, once binary, often binary")
    again = sent.groupBy("owner").applyInPandas(_twice, "block long, grams binary")
    found = rows.groupBy("block").cogroup(again.groupBy("block")).applyInPandas(
        _block_runs(owners), f"{OUT}, block long, row long, text string, owner long, runs binary, bytes binary, spans binary"
    )
    found = stored(found, "runs")
    own = found.filter("runs IS NOT NULL").select("block", "owner", "runs", "bytes").groupBy("owner").applyInPandas(_own, "block long, spans binary")
    spans = own.unionByName(found.filter("spans IS NOT NULL").select("block", "spans")).select(F.col("block").alias("of"), "spans")
    texts = found.filter("text IS NOT NULL").select("block", "doc_id", "no_id", "row", "text")
    cut = texts.groupBy("block").cogroup(spans.groupBy("of")).applyInPandas(_remove, OUT)
    out = found.filter("kept_sha256 IS NOT NULL").select(*(x.split()[0] for x in OUT.split(", "))).unionByName(cut)
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"))
