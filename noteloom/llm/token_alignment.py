"""Alignment of two tokenizers' tokens of the same texts by the bytes that they cover.

1. A task encodes its texts with both tokenizers in slices of bounded size. The tokens of a slice are two tables of
   document and byte offset; merge_asof, keyed by document, finds for each token start the token of the other side that
   covers it, in both directions. The union is all overlaps. Overlapping tokens of equal end close a group.
2. All tokens of a group's two sides are linked. Links are kept by id pair, with how often a document has them. A task also
   tells which pairs a block of documents (BLOCK_BYTES of text) has, and in how many of its documents.
3. Pairs are counted over all blocks, each id of the first side gets its highest count, and the counts of its pairs go back
   to each block. So a frequent pair travels once per block, not once per document.

Defined results: texts that are null or empty, or that either tokenizer doesn't give back byte by byte (after the leading
space), have no tokens and zeros; a special token's string in a text is plain text; repeated rows count as documents of their
own; null ids are allowed; an empty table gives an empty result; columns other than doc_id and text don't matter; texts are
encoded whole, and a group of many tokens is counted in pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.bpe import byte_letters
from noteloom.llm.common import slices, stored, table

SLICE_BYTES = 1_000_000
BLOCK_BYTES = 8_000_000
PAIRS = 2_000_000  # links that are laid out at a time
LONG_GROUP = 4096  # links of a group beyond which its ids are counted first


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_rank(path: str, ids: dict[bytes, int]):
    """An encoder of the same ids that takes a fifth of the time, if the file is plain byte-level BPE whose k-th merge makes the k-th token
    after the bytes (then a token's id is its rank); else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut, n = file["model"], file.get("pre_tokenizer") or {}, 256
    vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = model.get("type") == "BPE" and not file.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and cut.get("type") == "ByteLevel"
    plain = plain and cut.get("use_regex") and not cut.get("add_prefix_space") and sorted(vocab.get(x, -1) for x in byte_letters()) == list(range(n))
    if not plain or any(vocab.get(a + b) != n + k for k, (a, b) in enumerate(merges)):
        return None
    ranks = {word: k for word, k in ids.items() if k < n + len(merges)}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, bpe_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(bpe_path)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte = {letter: k for k, letter in enumerate(byte_letters())}
        words = a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, k in words.items():
            self.a_bytes[k] = bytes(byte[x] for x in word) if all(x in byte for x in word) else word.encode()
        ranked = _by_rank(bpe_path, {w: k for k, w in enumerate(self.a_bytes)})
        self.ids_of = (lambda texts: [ranked.encode_ordinary(t) for t in texts]) if ranked else (lambda texts: [x.ids for x in a.encode_batch_fast(texts, add_special_tokens=False)])
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([f"{k}{sep}" for sep in (",", last) for k in range(len(side))], object) for side, last in ((self.a_bytes, "|"), (self.b_bytes, ";")))

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of each text; none where the bytes of either aren't those of the text after a space."""
        a = self.ids_of([f" {t}" for t in texts if t])
        b = self.b.encode([t for t in texts if t], num_threads=1)
        out, at = ([], []), 0
        for t in texts:
            ids = ([], [])
            if t:
                want = f" {t}".encode()
                if b"".join(map(self.a_bytes.__getitem__, a[at])) == want and b"".join(map(self.b_bytes.__getitem__, b[at])) == want:
                    ids = (a[at], b[at])
                at += 1
            out[0].append(ids[0])
            out[1].append(ids[1])
        return out


@lru_cache(1)
def tokenizers(bpe_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(bpe_path, piece_path)


def overlaps(doc_a, begin_a, doc_b, begin_b) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of overlapping tokens, each pair once. begin: byte offsets that rise over all documents of the slice."""
    a = pd.DataFrame({"doc": doc_a, "at": begin_a, "i": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "at": begin_b, "j": np.arange(len(doc_b))})
    over_a, over_b = pd.merge_asof(a, b, on="at", by="doc"), pd.merge_asof(b, a, on="at", by="doc")
    more = over_b[begin_a[over_b["i"]] < begin_b]  # where both begin, the other direction has them
    i, j = (np.concatenate([over_a[c].to_numpy(np.int64), more[c].to_numpy(np.int64)]) for c in "ij")
    return i, j


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)


class Slice:
    """Tokens, groups and links of a slice of texts."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        a, b = t.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, self.n_a), (b, self.n_b)))
        self.doc_a, self.doc_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        end_a, end_b = np.cumsum(t.a_size[self.a]), np.cumsum(t.b_size[self.b])  # equal bytes of each document: the offsets agree
        i, j = overlaps(self.doc_a, end_a - t.a_size[self.a], self.doc_b, end_b - t.b_size[self.b])
        stops = np.zeros(len(end_a), bool)
        stops[i[end_a[i] == end_b[j]]] = True
        stop = end_a[stops]
        self.in_a, self.in_b = np.searchsorted(stop, end_a), np.searchsorted(stop, end_b)
        self.of_a, self.of_b = np.bincount(self.in_a, minlength=len(stop)), np.bincount(self.in_b, minlength=len(stop))
        self.first_a, self.first_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b
        self.doc = self.doc_a[self.first_a]
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        before = np.concatenate([[0], np.cumsum(self.of_a * self.of_b)])
        ends = np.cumsum(self.n_groups)
        self.n_links = before[ends] - before[ends - self.n_groups]
        self.base = len(t.b_bytes)
        self.pairs = len(t.a_bytes) * self.base

    def digests(self, t: Tokenizers) -> list[str]:
        """SHA-256 of each document's groups as text."""
        parts = np.empty(len(self.a) + len(self.b), object)
        last_a = np.diff(self.in_a, append=-1) != 0
        last_b = np.diff(self.in_b, append=-1) != 0
        parts[np.arange(len(self.a)) + self.first_b[self.in_a]] = t.a_text[self.a + last_a * len(t.a_bytes)]
        parts[np.arange(len(self.b)) + (self.first_a + self.of_a)[self.in_b]] = t.b_text[self.b + last_b * len(t.b_bytes)]
        ends, out, begin = np.cumsum(self.n_a + self.n_b), [], 0
        for end in ends.tolist():
            out.append(sha256("".join(parts[begin:end].tolist())[:-1].encode()).hexdigest() if end > begin else "")
            begin = end
        return out

    def _long(self, g: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of one long group: its distinct ids of both sides, row by row."""
        side = lambda ids, first, of: np.unique(ids[first[g] : first[g] + of[g]], return_counts=True)
        (a, times_a), (b, times_b) = side(self.a, self.first_a, self.of_a), side(self.b, self.first_b, self.of_b)
        step = max(1, PAIRS // len(b))
        for k in range(0, len(a), step):
            yield ((self.doc[g] * self.pairs + a[k : k + step] * self.base)[:, None] + b).ravel(), np.outer(times_a[k : k + step], times_b).ravel()

    def _short(self, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = (self.of_a * self.of_b)[groups]
        ends, begin = np.cumsum(size), 0
        while begin < len(groups):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
            g, n = groups[begin:end], size[begin:end]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            g = np.repeat(g, n)
            yield self.doc[g] * self.pairs + self.a[self.first_a[g] + at // self.of_b[g]] * self.base + self.b[self.first_b[g] + at % self.of_b[g]], np.ones(len(g))
            begin = end

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted document * pairs + a * base + b, and how often."""
        long = self.of_a * self.of_b > LONG_GROUP
        keys, times, held = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        for part in [self._short(np.flatnonzero(~long)), *(self._long(g) for g in np.flatnonzero(long))]:
            for k, n in part:
                keys.append(k)
                times.append(n)
                held += len(k)
                if held > 2 * PAIRS:
                    k, n = _summed(keys, times)
                    keys, times, held = [k], [n], 0
        return _summed(keys, times)


SCHEMA = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<long>"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _aligned(paths: tuple[str, str]):
    """Rows of documents, and for each block one row without n_a that has its pairs and their number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tokenizers(*paths), TaskContext.get().partitionId()
        block, size, own = part << 32, 0, ([np.zeros(0, np.int64)], [np.zeros(0)])

        def told() -> pa.RecordBatch:
            key, n = _summed(*own)
            null = lambda kind: pa.nulls(1, kind)
            some = [_lists(v, np.array([len(key)]), k) for v, k in ((key // len(t.b_bytes), pa.int32()), (key % len(t.b_bytes), pa.int32()), (n, pa.int64()))]
            return pa.RecordBatch.from_arrays([null(pa.int64()), pa.array([block]), *(null(pa.int64()) for _ in range(4)), null(pa.string()), *some], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                s = Slice(t, piece.column(1).to_pylist())
                key, times = s.links()
                ends = np.searchsorted(key, np.arange(1, piece.num_rows + 1) * s.pairs)
                key = key % s.pairs
                whole = [piece.column(0), pa.array(np.full(piece.num_rows, block)), *(pa.array(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)), pa.array(s.digests(t), pa.string())]
                yield pa.RecordBatch.from_arrays([*whole, _lists(key // s.base, ends, pa.int32()), _lists(key % s.base, ends, pa.int32()), _lists(times, ends, pa.int64())], names)
                k, n = np.unique(key, return_counts=True)
                own[0].append(k)
                own[1].append(n)
                size += piece.column(1).nbytes
                if len(own[0]) > 8:
                    own = tuple([x] for x in _summed(*own))
                if size >= BLOCK_BYTES:
                    yield told()
                    block, size, own = block + 1, 0, ([np.zeros(0, np.int64)], [np.zeros(0)])
        if size:
            yield told()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _with_counts(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents. pairs: a, b, count, best."""
    flat = lambda t, c: t.column(c).combine_chunks()
    whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    known = whole(flat(pairs, "a")) << 32 | whole(flat(pairs, "b"))
    order = np.argsort(known)
    known, count, best = known[order], whole(flat(pairs, "count"))[order], whole(flat(pairs, "best"))[order]
    lists = {c: flat(docs, c) for c in ("a", "b", "times")}
    key = whole(lists["a"].flatten()) << 32 | whole(lists["b"].flatten())
    at, times = np.searchsorted(known, key), whole(lists["times"].flatten())
    ends = np.cumsum(whole(pa.compute.list_value_length(lists["a"])))
    upto = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[ends] - c[np.concatenate([[0], ends[:-1]])]
    rest = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    rest = rest.append_column("n_best", pa.array(upto(times * best[at]))).append_column("count_sum", pa.array(upto(times * count[at])))
    return rest.append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, block, n_a, n_b, n_groups, n_links, groups_sha256 and the links as arrays a, b, times of each row of docs, in a
    stored table; rows without n_a are a block's pairs (a, b) and, in times, in how many of its documents they are linked."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_aligned(paths or default_vocabularies()), SCHEMA), "aligned")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold a pair linked, and whether no pair of its a is in more. pairs: block, a, b, docs."""
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align(docs, paths)
    pairs = aligned.filter("n_a IS NULL").select("block", F.inline(F.arrays_zip("a", "b", "times"))).withColumnRenamed("times", "docs")
    back = pairs.select(F.col("block").alias("to"), "a", "b").join(pair_counts(pairs), ["a", "b"])
    own = aligned.filter("n_a IS NOT NULL")
    return own.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_with_counts, RESULT)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
