"""Numbers for tokens and n-grams of pairs, and counts by them, for all pairs of a slice of rows at once, in the task that has the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 500_000  # tokens that a task looks at at a time, if no pair has more
SLICE_BYTES = 3_000_000  # and bytes of texts
_BEYOND = 0x3001  # stands for all code points from it on
_CODES = np.zeros(_BEYOND + 1, np.uint8)  # a number for each letter or digit of scalars.TOKEN, the same for both cases; 0 for what is none
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789абвгдежзийклмнопрстуфхцчшщъыьэюяё", 1):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _k
_SPACES = np.zeros(_BEYOND + 1, bool)
_SPACES[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_MARKS = np.isin(np.arange(_BEYOND + 1), [ord(c) for c in ".!?"])


def row_slices(batch: pa.RecordBatch, lists: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE tokens, of one row at least."""
    ends, begin = np.cumsum(sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_slices(batch: pa.RecordBatch, columns: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE_BYTES of texts, of one row at least."""
    ends, begin = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _code_points(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another (_BEYOND for those from it on), and where each text begins."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    if raw.max() < 0x80:
        return raw, at
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    return np.minimum(points, _BEYOND), np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]


def _different(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each stretch of bytes that ends at ends[1:]; equal stretches have equal numbers."""
    found = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(texts: pa.StringArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A number for each token of scalars.tokens() of the texts, and where each text begins; then the same for the sentences with words (scalars.sentences(), but
    repeated ones too). Equal tokens, and equal sentences, have equal numbers. No text is null."""
    points, first = _code_points(pc.binary_join_element_wise(texts, "\n", ""))  # so that no token, and no sentence, goes on in the next text
    codes = _CODES[points]
    inside = codes > 0
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([[0], turns]) if inside[0] else turns
    begin, end = turns[::2], turns[1::2]
    inside[end] = True  # a 0 ends each token
    data, ends = codes[inside], np.concatenate([[0], np.cumsum(end - begin + 1)])
    tokens = _different(data, ends), np.searchsorted(begin, first)
    # sentences are lower-cased before their words are found, which makes words of two letters that otherwise are none
    if points.itemsize > 1 and ((points == 0x212A) | (points == 0x130)).any():
        return [tokens, words_of(pc.replace_substring(pc.replace_substring(texts, "\u212a", "k"), "\u0130", "i\u0307"))[1]]
    spaces = np.flatnonzero(_SPACES[points[1:]]) + 1
    cuts = np.concatenate([spaces[_MARKS[points[spaces - 1]]], first[1:] - 1])
    new = np.flatnonzero(np.diff(np.searchsorted(np.sort(cuts), begin), prepend=-1))
    return [tokens, (_different(data, ends[np.append(new, len(begin))]), np.searchsorted(begin[new], first))]


def sides_of(of: tuple[np.ndarray, np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of words_of() of the texts of the given places, one text after another, and where each begins."""
    found, first = of
    counts = np.diff(first)[texts]
    at, _ = stretch_places(np.arange(len(texts)), first[texts], counts)
    return found[at], np.concatenate([[0], np.cumsum(counts)])


def numbers(values: np.ndarray) -> np.ndarray:
    """A number for each value; equal values have equal numbers."""
    return pd.factorize(values)[0]


def gram_ids(tokens: np.ndarray, n: int) -> np.ndarray:
    """A number for the n-gram that begins at each place, by doubling; equal n-grams have equal numbers."""
    ids, size = tokens.astype(np.int64), 1
    while size < n:
        step = min(size, n - size)  # the second half may overlap the first
        if len(ids) <= step:
            return ids[:0]
        ids = numbers(ids[:-step] * (int(ids.max()) + 1) + ids[step:])
        size += step
    return ids


def stretch_places(region: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of the stretches from `begin` on of `count` places, and its region."""
    first = np.cumsum(count) - count
    return np.repeat(begin - first, count) + np.arange(count.sum()), np.repeat(region, count)


def list_begins(lists: pa.ListArray) -> np.ndarray:
    """The places of each list's begin in their flattened values, and of the end; null lists are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def shared_counts(pair: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], pairs: int) -> list[np.ndarray]:
    """Of numbers `of` of both sides and their pairs: distinct ones of each side and of both, and the sum of the lesser counts, by pair."""
    top = max((int(x.max()) + 1 for x in of if len(x)), default=1)
    keys, known = pd.factorize(np.concatenate([p * top + x for p, x in zip(pair, of, strict=True)]))
    m, owner = len(of[0]), known // top
    n, k = (np.bincount(x, minlength=len(known)) for x in (keys[:m], keys[m:]))
    return [np.bincount(owner, x, pairs).astype(np.int64) for x in (n > 0, k > 0, (n > 0) & (k > 0), np.minimum(n, k))]


def sides_in_texts(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """words_of() the texts of the first column, then of the second; a text that is there again, as a source for its candidates, is read once."""
    known = pa.concat_arrays([pc.fill_null(batch.column(c), "") for c in (0, 1)]).dictionary_encode()
    which = known.indices.to_numpy(zero_copy_only=False)
    return [sides_of(x, which) for x in words_of(known.dictionary)]


def _overlaps(sizes: tuple[int, ...], texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in (text_slices if texts else row_slices)(b, (0, 1))):
            m = batch.num_rows
            if texts:
                tokens, begin = sides_in_texts(batch)[0]
                a, b = begin[: m + 1], begin[m:] - begin[m]
            else:
                a, b = (list_begins(batch.column(c)) for c in (0, 1))
                tokens = pa.concat_arrays([batch.column(c).flatten() for c in (0, 1)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            counts = [np.diff(a), np.diff(b)]
            for n in sizes:
                found = gram_ids(tokens, n)
                sides = [stretch_places(np.arange(m), x[:-1], np.maximum(np.diff(x) - (n - 1), 0)) for x in (a, b + a[-1])]
                counts.append(shared_counts(*zip(*((p, found[at]) for at, p in sides), strict=True), m)[3])
            names = ["words_source", "words_candidate", *(f"overlap{n}" for n in sizes)]
            yield pa.RecordBatch.from_arrays(batch.columns[2:] + [pa.array(x.astype(np.int64)) for x in counts], batch.schema.names[2:] + names)

    return run


def overlaps(pairs: DataFrame, key: list[str], *sizes: int) -> DataFrame:
    """(key, words_source, words_candidate, overlap<n> of each of the sizes): overlap<n> is the sum, over the n-grams that both sides of a pair have, of the
    lesser count. pairs: with tokens st and ct, or with cleaned texts source_clean and candidate_clean. N-grams meet by their numbers where the pair is, so none is written out as a text."""
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in key] + [f"{c} long" for c in ("words_source", "words_candidate", *(f"overlap{n}" for n in sizes))])
    texts = "source_clean" in pairs.columns
    return pairs.select(*(("source_clean", "candidate_clean") if texts else ("st", "ct")), *key).mapInArrow(_overlaps(sizes, texts), schema)
