"""Byte-pair encoding and decoding with a pair-occurrence index.

A task cuts its texts into pre-tokens, takes the distinct ones it has not met, lays their bytes end to
end and maps each adjacent pair to all its positions. Ranks that are active are applied in ascending
order, each to all positions of its pair; a merge updates the lists of the pairs beside it. Pairs never
cross pre-tokens. That gives what merging each pre-token by itself gives, because a merge only ever
makes pairs of higher rank than its own.

Texts go through in slices of bounded size, and the memory of known pre-tokens is bounded too, so
neither long texts nor large partitions matter. There is no shuffle: a lost task is run again.

Defined results: null or empty text has no tokens and decodes to the empty text; repeated rows are
encoded alike; empty tables give empty results; columns other than id and text aren't looked at. A
special token's string in a text is that token, as in the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import slices, table, tidy

SLICE_BYTES = 4_000_000
KNOWN_WORDS = 300_000
FEW = 24
# The pre-token pattern of the byte-level vocabulary.
# White space is what Unicode says it is; \s of some pattern libraries has the four separators U+001C to U+001F too.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def _merge_few(sym, nxt, prev, key: int, new: int, at: list[int]) -> list[tuple[int, int]]:
    """Merge a pair at those of the (ascending) places where it still stands; the pairs then beside it, with their places."""
    a, b = key >> 16, key & 0xFFFF
    beside = []
    for i in at:
        j = nxt[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = new, -1
        k, p = nxt[j], prev[i]
        nxt[i] = k
        if k >= 0:
            prev[k] = i
            beside.append((new << 16 | sym[k], i))
        if p >= 0:
            beside.append((sym[p] << 16 | new, p))
    return beside


def _merge_many(sym: np.ndarray, nxt: np.ndarray, prev: np.ndarray, key: int, new: int, at: list[int]) -> Iterable[tuple[int, int]]:
    """The same for many places at once."""
    a, b = key >> 16, key & 0xFFFF
    i = np.unique(np.array(at))
    j = nxt[i]
    i = i[(sym[i] == a) & (j >= 0) & (sym[j] == b)]
    if a == b and len(i) > 1:  # in a run of overlapping places every second one is merged
        joined = np.concatenate([[False], nxt[i[:-1]] == i[1:]])
        first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(i))))
        i = i[(np.arange(len(i)) - first) % 2 == 0]
    j = nxt[i]
    k = nxt[j]
    sym[i], sym[j], nxt[i] = new, -1, k
    right = k >= 0
    prev[k[right]] = i[right]
    p = prev[i]
    left = p >= 0
    pairs = np.concatenate([new << 16 | sym[k[right]], sym[p[left]] << 16 | new])
    return zip(pairs.tolist(), np.concatenate([i[right], p[left]]).tolist(), strict=True)


class Vocabulary:
    """Tables of a byte-level BPE file, and the encoder and decoder over them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(of_letter[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.first = np.array([ids[c] for c in letters], np.int64)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            key = ids[a] << 16 | ids[b]
            self.rank[key] = rank
            self.made[key] = ids[a + b]
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, special tokens among them."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.cut.findall(text)
        out: list[str] = []
        for k, piece in enumerate(self.cut_special.split(text)):
            out += [piece] if k % 2 else self.cut.findall(piece)
        return out

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each of the (non-empty) words, by one index over all of them."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        start = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(start)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        after = np.arange(1, n + 1)
        after[last] = -1
        before = np.arange(-1, n - 1)
        before[0] = -1
        before[ends[:-1]] = -1
        pairs = np.where(last[:-1], -1, start[:-1] << 16 | start[1:])
        order = np.argsort(pairs, kind="stable")
        keys, at = np.unique(pairs[order], return_index=True)
        places = np.split(order, at[1:])
        index = {int(k): p.tolist() for k, p in zip(keys, places, strict=True) if int(k) in self.rank}
        rank, made = self.rank, self.made
        active = [(rank[k], k) for k in index]
        heapq.heapify(active)
        arrays = sym, nxt, prev = start.copy(), after, before
        views = tuple(map(memoryview, arrays))  # the same memory, quicker for single places
        while active:
            _, key = heapq.heappop(active)
            at = sorted(index.pop(key))
            beside = _merge_many(*arrays, key, made[key], at) if len(at) > FEW else _merge_few(*views, key, made[key], at)
            for pair, place in beside:
                if pair in index:
                    index[pair].append(place)
                elif pair in rank:
                    index[pair] = [place]
                    heapq.heappush(active, (rank[pair], pair))
        stays = sym >= 0
        ids = sym[stays].tolist()
        bounds = np.concatenate([[0], np.cumsum(stays)[ends - 1]]).tolist()
        return [tuple(ids[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.words(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        known |= {s: (i,) for s, i in self.special.items()}
        fresh = list(set().union(*cut) - known.keys())
        if fresh:
            known |= zip(fresh, self.merge([w.encode() for w in fresh]), strict=True)
        return [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in cut]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(filter(None, map(self.bytes_of.get, ids))).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids = vocab.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    return run


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        name = {i: str(i) for i in vocab.bytes_of}
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids = vocab.encode([t or "" for t in part.column(1).to_pylist()])
                listed = [sha256(",".join(map(name.__getitem__, x)).encode()).hexdigest() for x in ids]
                decoded = [sha256(vocab.decode(x).encode()).hexdigest() for x in ids]
                columns = [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_encode_rows(path or default_vocabulary())), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of encode()'s result; ids beyond the vocabulary stand for nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_rows(path or default_vocabulary()), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _round_trip(path or default_vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
