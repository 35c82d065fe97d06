"""Spelling variants: words one edit apart, by an index of variable-length grams.

1. Dictionary. All grams of QMIN to QMAX letters of the words (with a mark at both ends) are counted. A gram that is in
   more than one of MOST_GRAMS places is worth extending: the grams one letter longer are in the dictionary, and so on.
   Rare grams aren't extended, so the dictionary is pruned by frequency: at most MOST_GRAMS grams of a length are extended,
   by at most LETTERS letters each, and this bounds what goes to the driver and to the tasks.
2. Decomposition. At each place of a word stands the longest dictionary gram (else QMIN letters), unless a gram that
   begins earlier reaches as far.
3. Affected grams. An edit at place i can only change a gram before i if what is left of the word from some place up
   to i begins a dictionary gram that is longer, and a gram behind i only if its end is also inside of a dictionary gram that
   begins at or before i. The most grams that any single edit can change so is the word's bound k.
4. Merging. Two words one edit apart share all but k of a word's grams, so they meet in the lists of the k + 1
   rarest of each. A gram that the edit leaves whole is before or behind it, and then so is all before (behind) that gram: a
   list is that of a gram with what is before it, or behind it. Words in a list that are as long, or one letter longer, are compared
   by hashes of their halves, one of which must be whole, and then by their edit distance. Words all of whose grams may be affected also meet in lists of
   fixed grams of QMIN letters, of which an edit changes QMIN at most.

A word's form is its near word of largest n, if that is FACTOR times the word's own or more; roots follow forms by
pointer jumping (n grows tenfold with each step, so six rounds are enough for any count).

Defined results: null and empty texts and runs of fewer letters have no words; repeated rows count each; a null doc_id is taken
as empty text in the perturbation; near words of equal n are taken in code-point order; an empty table gives an empty
result; columns other than doc_id and text don't matter; texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import ascii_lower, discard, stored, table

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
PERTURBED = 31
QMIN, QMAX = 2, 4
MOST_GRAMS = 20_000
LETTERS = 26 + 64 + 2  # a-z, U+00C0 to U+00FF, the marks
BEGIN, END = "^", "$"
AT_MARKS = 10  # a gram at a mark counts as so many times as frequent: what is before or behind it tells little
FLUSH = 500_000  # grams that a task counts before it gives them on


def perturbed_words(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more."""
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", ascii_lower(F.col("run")))
    rows = rows.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % PERTURBED == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Decomposer:
    """The dictionary, and what follows from it: grams of a word, and how many of them an edit can change."""

    def __init__(self, grams: set[str], qmin: int = QMIN, qmax: int = QMAX):
        self.grams, self.qmin, self.qmax = grams, qmin, qmax
        self.begins = {g[:k] for g in grams for k in range(1, len(g))}
        self.inside = {g[j:k] for g in grams for j in range(1, len(g)) for k in range(j + 1, len(g) + 1)}

    def of(self, p: str) -> list[tuple[int, int]]:
        """(begin, end) of the grams of a marked word."""
        out, reach, n = [], 0, len(p)
        for i in range(n - self.qmin + 1):
            end = i + self.qmin
            while end < n and end - i < self.qmax and p[i : end + 1] in self.grams:
                end += 1
            if end > reach:
                out.append((i, end))
                reach = end
        return out

    def affected(self, p: str, grams: list[tuple[int, int]]) -> int:
        """The most of these grams that one inserted, deleted or replaced letter between the marks can change."""
        n = len(p)
        replaced, inserted, before = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for begin, end in grams:
            before[begin + 1] += 1
            replaced[begin] += 1
            b = begin
            while b > 0 and p[b:end] in self.inside:
                inserted[b] += 1
                replaced[b - 1] += 1
                b -= 1
        for i in range(n):
            before[i + 1] += before[i]
        most = 0
        for i in range(1, n):
            low = next((s for s in range(max(0, i - self.qmax + 1), i) if i - s < self.qmin or p[s:i] in self.begins), i)
            left = before[i] - before[low]
            most = max(most, left + inserted[i], left + replaced[i] if i < n - 1 else 0)
        return most

    def lists(self, word: str, often: dict[str, int]) -> list[bytes]:
        """Names of the lists that a word is in."""
        p = BEGIN + word + END
        grams = self.of(p)
        k = self.affected(p, grams)
        weight = lambda x: AT_MARKS if x[0] == 0 or x[1] == len(p) else 1
        rarest = lambda x: (often.get(p[x[0] : x[1]], 0) * weight(x), p[x[0] : x[1]], x[0])
        out = [name for g in sorted(grams, key=rarest)[: k + 1] for name in self.sides(p, *g)]
        if len(grams) <= k:
            fixed = [(i, i + self.qmin) for i in range(len(p) - self.qmin + 1)]
            out += [b"F" + name for g in sorted(fixed, key=rarest)[: self.qmin + 1] for name in self.sides(p, *g)]
        return out

    @staticmethod
    def sides(p: str, begin: int, end: int) -> tuple[bytes, bytes]:
        return f"{begin}<{p[:end]}".encode(), f"{end - begin}>{p[begin:]}".encode()


def _counted(of) -> object:
    """For mapInArrow over words: (gram, n) of the grams that `of` gives for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        tell = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update(of(BEGIN + word + END))
            if len(seen) > FLUSH:
                yield tell()
                seen.clear()
        yield tell()

    return run


def counts(words: DataFrame, of) -> DataFrame:
    return words.select("word").mapInArrow(_counted(of), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def every_gram(qmin: int, qmax: int):
    return lambda p: [p[i : i + q] for q in range(qmin, qmax + 1) for i in range(len(p) - q + 1)]


def dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, most: int = MOST_GRAMS) -> Decomposer:
    """At most (qmax - qmin) * most * LETTERS grams come to the driver."""
    places = words.agg(F.sum(F.char_length("word") + 2)).first()[0] or 0
    all_ = stored(counts(words, every_gram(qmin, qmax)), "grams")
    frequent = all_.filter((F.col("n") * most > places) & (F.char_length("gram") < qmax)).select(F.col("gram").alias("short"))
    longer = all_.filter(F.char_length("gram") > qmin).withColumn("short", F.left("gram", F.char_length("gram") - 1)).join(frequent, "short", "left_semi")
    grams = {r.gram for r in longer.select("gram").toLocalIterator()}
    discard(words.sparkSession, all_)
    return Decomposer(grams, qmin, qmax)


def _halves(word: str) -> int:
    """16-bit hashes of the first and last n // 2 letters, and of the first and last (n - 1) // 2."""
    n, out = len(word), 0
    for k, half in enumerate((word[: n // 2], word[n - n // 2 :], word[: (n - 1) // 2], word[n - (n - 1) // 2 :])):
        out |= (xxhash.xxh32_intdigest(half.encode()) & 0xFFFF) << (16 * k)
    return out - (1 << 64) if out >> 63 else out


def _posts(d: Decomposer, often: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 5000):
                batch = whole.slice(begin, 5000)
                at, keys, halves = [], [], []
                words = batch.column(0).to_pylist()
                for k, word in enumerate(words):
                    names = d.lists(word, often)
                    keys += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]
                    at += [k] * len(names)
                    halves.append(_halves(word))
                at = pa.array(at, pa.int32())
                sizes = pa.array([len(w) for w in words], pa.int32())
                columns = [pa.array(keys, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), sizes.take(at), pa.array(halves, pa.int64()).take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "m", "halves"])

    return run


def near_pairs(words: DataFrame, d: Decomposer) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart once. words: word, n."""
    often = {r.gram: r.n for r in counts(words, lambda p: [p[i:j] for i, j in d.of(p)]).toLocalIterator()}  # at most the dictionary and LETTERS ** qmin
    posts = stored(words.select("word", "n").mapInArrow(_posts(d, often), "key long, word string, n long, m int, halves long"), "posts")
    other = posts.select(F.col("key").alias("k"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"), F.col("halves").alias("halves_b"))
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(0xFFFF)) == 0
    by = lambda c, k: F.shiftright(F.col(c), 16 * k)
    level = (F.col("m") == F.col("m_b")) & (same(F.col("halves"), F.col("halves_b")) | same(by("halves", 1), by("halves_b", 1))) & (F.col("word") < F.col("b"))
    longer = (F.col("m") < F.col("m_b")) & (same(F.col("halves"), by("halves_b", 2)) | same(by("halves", 1), by("halves_b", 3)))
    asks = posts.withColumn("length", F.explode(F.array("m", F.col("m") + 1)))
    on = (F.col("key") == F.col("k")) & (F.col("length") == F.col("m_b")) & (level | longer) & (F.levenshtein("word", "b", 1) == 1)
    return asks.join(other, on).select(F.col("word").alias("a"), F.col("n").alias("n_a"), "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where forms end."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")), "roots")
        found = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return found


def variants(words: DataFrame, d: Decomposer | None = None, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of words (word, n)."""
    pairs = stored(near_pairs(words, d or dictionary(words)), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("taken", -F.col("best.less") >= F.col("n") * factor)
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), F.col("best.near")).alias("form"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "forms")
    last = roots(rows.filter("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(perturbed_words(table(spark, sf_dir, "documents")), "words"))
