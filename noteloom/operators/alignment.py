"""Word alignment of all pairs at once: longest matching runs first, then the gaps beside them.

Regions of a pair are open where nothing is matched yet; at first all of it is. Levels go from long to short
n-grams: at a level of n, equal n-grams of a region become maximal diagonal runs, so all common runs of n tokens
or more are there and nothing else is. A round takes the runs of a region of the greatest length in order of
(i, j), chains them greedily, opens the gaps between them as the next regions and clips the runs to these. When
no region has a run of n tokens, the next level looks at what is open. A frequent token thus only meets its equals in
the gaps that longer runs have left, not in the whole pair.

A pair is a row, so its rounds need no other row: they are done where the row is, for all pairs of a slice of rows at once, and neither
n-grams, matches, runs nor regions are shuffled or stored. A pair of which one side begins with all of the other is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators.metrics import KEY, both_sides
from noteloom.operators.numbering import gram_ids, list_begins, row_slices, shared_counts, sides_in_texts, stretch_places, text_slices
from noteloom.sources.shared import settled

LEVELS = (24, 6, 3, 2, 1)
WIDTH = 64  # tokens of a stretch in which runs and regions meet
MATCHES = 2_000_000  # and matches


def token_match_join(pairs: DataFrame) -> DataFrame:
    """(source_id, candidate, i, j) of equal tokens; pairs: with tokens. Both sides' places meet under their pair and token, each of one side with each of
    the other; where pairs are dealt by source_id already, nothing is shuffled. The places of a token are those of one pair, and its matches
    follow one another and are never gathered."""
    at = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("at")))
    met = both_sides(pairs, F.col).groupBy(*KEY, "gram").agg(at(0).alias("is"), at(1).alias("js"))
    return met.select(*KEY, "js", F.explode("is").alias("i")).select(*KEY, "i", F.explode("js").alias("j"))


def token_match_sums(pairs: DataFrame) -> DataFrame:
    """(n, sum_i, sum_j) of each pair that shares a token, over the rows of token_match_join()."""
    return token_match_join(pairs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., st, ct) with a number for each token; equal tokens of a pair have equal numbers."""
    for batch in (x for b in batches for x in row_slices(b, (2, 3))):
        a, b = batch.column(2), batch.column(3)
        codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices
        begins = lambda x: pa.array(list_begins(x), pa.int32())
        cut = len(a.flatten())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(begins(a), codes[:cut]), pa.ListArray.from_arrays(begins(b), codes[cut:])], ["source_id", "candidate", "a", "b"])


def _region_runs(tokens: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(region, i, j, size) of maximal runs of n equal tokens or more of each region's two stretches. A run has one match that nothing
    goes before and one that nothing follows on its diagonal; only these are kept of a lot of matches."""
    region = np.flatnonzero((ahi - alo >= n) & (bhi - blo >= n))
    if not len(region):
        return (np.zeros(0, np.int64),) * 4
    alo, ahi, blo, bhi = (x[region] for x in (alo, ahi, blo, bhi))
    sizes = np.concatenate([ahi - alo, bhi - blo])
    places, _ = stretch_places(np.arange(len(sizes)), np.concatenate([alo, blo]), sizes)  # what is matched already isn't looked at
    tokens, ends = tokens[places], np.cumsum(sizes)
    (lo, hi), m = (ends - sizes, ends), len(region)
    ids = gram_ids(tokens, n)
    (i, ri), (j, rj) = (stretch_places(np.arange(m), lo[k], (hi - lo)[k] - (n - 1)) for k in (slice(m), slice(m, None)))
    alo, ahi, blo, bhi = lo[:m], hi[:m], lo[m:], hi[m:]
    top = int(ids.max()) + 1
    ki, kj = ri * top + ids[i], rj * top + ids[j]
    order = np.argsort(kj, kind="stable")
    left, right = np.searchsorted(kj[order], ki, "left"), np.searchsorted(kj[order], ki, "right")
    met, begins, ends, at = np.cumsum(right - left), [], [], 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + MATCHES, side="right")))
        found, k = stretch_places(np.arange(at, to), left[at:to], (right - left)[at:to])
        x, y, r = i[k], j[order[found]], ri[k]
        edge = (x == alo[r]) | (y == blo[r])
        first = edge | (tokens[x - 1] != tokens[y - 1])
        edge = (x + n == ahi[r]) | (y + n == bhi[r])
        last = edge | (tokens[np.minimum(x + n, len(tokens) - 1)] != tokens[np.minimum(y + n, len(tokens) - 1)])
        begins.append((r[first], x[first], y[first]))
        ends.append((r[last], x[last], y[last]))
        at = to
    (r, x, y), (q, u, v) = (tuple(np.concatenate(c) for c in zip(*part, strict=True)) for part in (begins, ends))
    one, two = np.lexsort((x, x - y, r)), np.lexsort((u, u - v, q))
    return region[r[one]], places[x[one]], places[y[one]], u[two] - x[one] + n


def _chained(region: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of blocks in order of region, i, j, the places of those that begin beyond the end of the last one taken in their region."""
    taken, of, x, y = [], -1, 0, 0
    for at, (r, a, b, size) in enumerate(zip(region.tolist(), i.tolist(), j.tolist(), n.tolist(), strict=True)):
        if r != of or (a >= x and b >= y):
            taken.append(at)
            of, x, y = r, a + size, b + size
    return np.array(taken, np.int64)


def _cut(runs: np.ndarray, regions: np.ndarray, least: int) -> np.ndarray:
    """(region, i, j, n): the parts of runs inside regions, of `least` tokens or more. Regions are disjoint and in order on both sides, so
    those that a run meets follow one another."""
    (_, i, j, n), (alo, ahi, blo, bhi) = runs, regions
    begin = np.maximum(np.searchsorted(ahi, i, "right"), np.searchsorted(bhi, j, "right"))
    end = np.minimum(np.searchsorted(alo, i + n, "left"), np.searchsorted(blo, j + n, "left"))
    r, k = stretch_places(np.arange(len(i)), begin, np.maximum(end - begin, 0))
    lo = np.maximum(0, np.maximum(alo[r] - i[k], blo[r] - j[k]))
    size = np.minimum(n[k], np.minimum(ahi[r] - i[k], bhi[r] - j[k])) - lo
    out = np.array([r, i[k] + lo, j[k] + lo, size])
    return out[:, size >= least]


def _round(regions: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks (region, i, j, n) that a round takes, the regions that have none and the gaps beside the blocks."""
    most = np.zeros(regions.shape[1], np.int64)
    np.maximum.at(most, runs[0], runs[3])
    longest = runs[:, runs[3] == most[runs[0]]]
    longest = longest[:, np.lexsort((longest[2], longest[1], longest[0]))]
    taken = longest[:, _chained(*longest)]
    r, i, j, n = taken
    own = regions[:, most > 0]
    # in the order of both sides: a gap before each block, and one behind the last block of a region
    first, last = np.diff(r, prepend=-1) > 0, np.diff(r, append=regions.shape[1]) > 0
    ends = np.array([i + n, j + n])
    before = np.where(first, regions[::2, r], np.concatenate([ends[:, :1], ends[:, :-1]], axis=1))
    gaps = np.array([np.concatenate(x) for x in ((before[0], ends[0][last]), (i, own[1]), (before[1], ends[1][last]), (j, own[3]))])
    gaps = gaps[:, (gaps[1] > gaps[0]) & (gaps[3] > gaps[2])]
    return taken, regions[:, most == 0], gaps[:, np.argsort(gaps[0], kind="stable")]


def _blocks(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """(pair, i, j, n): the matching blocks of pairs whose sides are tokens[a[p]:a[p + 1]] and tokens[b[p]:b[p + 1]]; i and j are places in tokens."""
    size = np.minimum(np.diff(a), np.diff(b))
    places, pair = stretch_places(np.arange(len(size)), a[:-1], size)
    differ = tokens[places] != tokens[places + (b - a)[pair]]
    begun = (size > 0) & (np.bincount(pair, differ, len(size)) == 0)
    found = [np.array([a[:-1], b[:-1], size])[:, begun]]
    rest = np.flatnonzero((size > 0) & ~begun)
    regions = np.array([a[rest], a[rest + 1], b[rest], b[rest + 1]])
    for n in levels:
        runs, closed = np.array(_region_runs(tokens, *regions, n)), []
        while runs.shape[1]:
            taken, none, regions = _round(regions, runs)
            found.append(taken[1:])
            closed.append(none)
            runs = _cut(runs, regions, n)
        regions = np.concatenate([*closed, regions], axis=1)
        regions = regions[:, np.argsort(regions[0], kind="stable")]
    i, j, n = np.concatenate(found, axis=1)
    return np.array([np.searchsorted(a, i, "right") - 1, i, j, n])


def _blocks_of(levels: tuple[int, ...]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in row_slices(b, (2, 3))):
            a, b = list_begins(batch.column(2)), list_begins(batch.column(3))
            tokens = np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3)])
            b = b + a[-1]
            p, i, j, n = _blocks(tokens, a, b, levels)
            ints = [pa.array(x, pa.int32()) for x in (i - a[p], j - b[p], n)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(p)) for c in (0, 1)] + ints, [*KEY, "i", "j", "n"])

    return found


def meeting(regions: DataFrame, runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Regions (alo, ahi, ...) and runs (i0, j0, n) of a pair that overlap in i, each two once. Both are dealt to stretches
    of `width` tokens of i and meet in the first stretch that has both. Regions are disjoint in i, so a stretch has no
    more than `width` of them, and a run meets those that it may cut, not all of its pair."""
    dealt = lambda df, lo, hi: df.withColumn("slot", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((hi - 1) / width))))
    both = dealt(regions, "alo", F.col("ahi")).join(dealt(runs, "i0", F.col("i0") + F.col("n")), [*KEY, "slot"])
    first = F.floor(F.greatest("alo", "i0") / width)
    return both.filter((F.col("alo") < F.col("i0") + F.col("n")) & (F.col("i0") < F.col("ahi")) & (F.col("slot") == first)).drop("slot")


def _key(pairs: DataFrame) -> str:
    return "source_id {source_id}, candidate {candidate}".format(**{c: pairs.schema[c].dataType.simpleString() for c in KEY})


def word_alignment(pairs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(source_id, candidate, i, j, n): the matching blocks. pairs: with tokens st and ct. The last level must be 1."""
    some = pairs.select(*KEY, "st", "ct").filter(F.least(F.size("st"), F.size("ct")) > 0)
    numbers = settled(some.mapInArrow(_numbered, f"{_key(pairs)}, a array<int>, b array<int>"), "numbers")
    return numbers.mapInArrow(_blocks_of(levels), f"{_key(pairs)}, i int, j int, n int")


COUNTS = ("words_source", "words_candidate", "equal_words", "vocab_source", "vocab_candidate", "vocab_both", "overlap1", "overlap2")
SENTENCES = ("sentences_candidate", "sentences_both")


def _counts(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, levels: tuple[int, ...]) -> list[np.ndarray]:
    """COUNTS of the pairs whose sides are tokens[a[p]:a[p + 1]] and tokens[b[p]:b[p + 1]]."""
    m = len(a) - 1
    two = gram_ids(tokens, 2) if len(tokens) > 1 else tokens[:0]
    stretches = lambda n: [stretch_places(np.arange(m), x[:-1], np.maximum(np.diff(x) - (n - 1), 0)) for x in (a, b)]
    one = shared_counts(*zip(*((p, tokens[at]) for at, p in stretches(1)), strict=True), m)
    pairs = shared_counts(*zip(*((p, two[at]) for at, p in stretches(2)), strict=True), m)
    p, _, _, n = _blocks(tokens, a, b, levels)
    return [np.diff(a), np.diff(b), np.bincount(p, n, m), *one, pairs[3]]


def _with_counts(batch: pa.RecordBatch, names: tuple[str, ...], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns[2:] + [pa.array(x.astype(np.int64)) for x in counts], batch.schema.names[2:] + list(names))


def _counted(levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in row_slices(b, (0, 1))):
            a, b = (list_begins(batch.column(c)) for c in (0, 1))
            tokens = pa.concat_arrays([batch.column(c).flatten() for c in (0, 1)]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            yield _with_counts(batch, COUNTS, _counts(tokens, a, b + a[-1], levels))

    return run


def _counted_texts(levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in text_slices(b, (0, 1))):
            m = batch.num_rows
            (tokens, begins), (lines, ends) = sides_in_texts(batch)
            pair, cut = np.repeat(np.arange(2 * m) % m, np.diff(ends)), ends[m]
            _, distinct, both, _ = shared_counts((pair[:cut], pair[cut:]), (lines[:cut], lines[cut:]), m)
            yield _with_counts(batch, (*COUNTS, *SENTENCES), [*_counts(tokens, begins[: m + 1], begins[m:], levels), distinct, both])

    return run


def counted(pairs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The pairs with COUNTS instead of st and ct, all of them made in one pass over the rows: tokens of both sides, those in matching blocks of the alignment,
    distinct ones of each side and of both, and the sums of the lesser counts of tokens and of two in a row."""
    rest = [c for c in pairs.columns if c not in ("st", "ct", *COUNTS)]
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in rest] + [f"{c} long" for c in COUNTS])
    return pairs.select("st", "ct", *rest).mapInArrow(_counted(levels), schema)


def counted_texts(pairs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The pairs with COUNTS and SENTENCES (distinct ones of the candidate, and of these those that the source has) instead of their cleaned texts source_clean and
    candidate_clean: counted() without lists of tokens and sentences, which are found in the texts of a slice of rows at once."""
    made = ("source_clean", "candidate_clean")
    rest = [c for c in pairs.columns if c not in (*made, *COUNTS, *SENTENCES)]
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in rest] + [f"{c} long" for c in (*COUNTS, *SENTENCES)])
    return pairs.select(*made, *rest).mapInArrow(_counted_texts(levels), schema)


def alignment_metrics(pairs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """equal_words and what follows from it, of each pair; two empty sides have ratio 1. Without blocks, pairs have COUNTS."""
    if blocks is None:
        rows = pairs.select(*KEY, F.col("words_source").alias("a"), F.col("words_candidate").alias("b"), "equal_words")
    else:
        sums = blocks.groupBy(*KEY).agg(F.sum("n").alias("equal_words"))
        rows = pairs.select(*KEY, F.size("st").alias("a"), F.size("ct").alias("b")).join(sums, KEY, "left").na.fill(0, ["equal_words"])
    share = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    m, a, b = F.col("equal_words"), F.col("a"), F.col("b")
    return rows.select(
        *KEY, "equal_words", F.when(a + b == 0, 1.0).otherwise(share(m * 2, a + b)).alias("word_seq_ratio"),
        (share(m, a) * 100).alias("base_words_preserved_pct"), (share(m, b) * 100).alias("candidate_words_aligned_pct"),
    )
