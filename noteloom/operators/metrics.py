"""Fidelity of candidate texts to their source: overlaps of n-grams, vocabularies and sentences, composites, ranks.

Tables are keyed by source_id and candidate. A pair is a row that has both texts: its vocabularies and sentences are compared in the row,
its n-grams are counted by their numbers there (numbering.overlaps), or become rows that are counted by pair and n-gram. Where the pairs are dealt
by source_id already, in small partitions (fixtures.pairs_with), these counts need no shuffle: the texts moved once, instead of their n-grams. Columns that a table of
pairs has already (st, ct, ss, cs) are taken from it: a source's are made once for all its candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.operators.numbering import overlaps
from noteloom.operators.ranges import numbered
from noteloom.sources.shared import settled

KEY = ["source_id", "candidate"]


def source_tokens(text: Column) -> Column:
    return s.tokens(s.clean_source(text))


def source_sentences(text: Column) -> Column:
    return s.sentences(s.clean_source(text))


def with_parts(pairs: DataFrame, *names: str) -> DataFrame:
    """The pairs with those of the named columns that they lack: st, ct (tokens), ss, cs (sentences), chars_source, chars_candidate."""
    source, candidate, clean = F.col("source_text"), F.col("candidate_text"), s.clean_markdown(F.col("candidate_text"))
    made = {
        "st": lambda: source_tokens(source), "ct": lambda: s.tokens(clean),
        "ss": lambda: source_sentences(source), "cs": lambda: s.sentences(clean),
        "chars_source": lambda: F.length(source), "chars_candidate": lambda: F.length(candidate),
    }
    lacking = [c for c in made if c in names and c not in pairs.columns]
    if {"ct", "cs"} <= set(lacking):  # a column of its own is made once for both
        pairs, clean = pairs.withColumn("clean", clean), F.col("clean")
    return pairs.withColumns({c: made[c]() for c in lacking}).select(*(c for c in pairs.columns if c != "clean"), *lacking)


def token_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs with arrays st and ct of the source's and the candidate's tokens."""
    return with_parts(pairs, "st", "ct")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Characters of the raw texts, words of the cleaned ones. pairs: with texts, or with words_source and chars_source already."""
    if "words_source" not in pairs.columns:
        pairs = pairs.withColumns({"words_source": s.n_tokens(s.clean_source(F.col("source_text"))), "chars_source": F.length("source_text")})
    words = s.n_tokens(s.clean_markdown(F.col("candidate_text")))
    return pairs.select(*KEY, "chars_source", F.length("candidate_text").alias("chars_candidate"), "words_source", words.alias("words_candidate"))


def pair_join(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    return sources.join(candidates, "source_id")


def grams(pairs: DataFrame, n: int, side: str) -> DataFrame:
    """One row per n-gram of one side ('st' or 'ct'), none if there are fewer than n tokens."""
    return pairs.select(*KEY, F.explode(s.grams(F.col(side), n)).alias("gram"))


def ngram_counts(pairs: DataFrame, n: int, side: str) -> DataFrame:
    """(gram, cnt) of one side. Counted in the pair's row."""
    return pairs.select(*KEY, F.inline(s.counted(s.grams(F.col(side), n))))


def both_sides(pairs: DataFrame, of: Callable[[str], Column]) -> DataFrame:
    """(source_id, candidate, side, at, gram): the entries of the lists of('st'), side 0, and of('ct'), side 1, of each pair."""
    lists = pairs.select(*KEY, F.posexplode(F.array(of("st"), of("ct"))).alias("side", "entries"))
    return lists.select(*KEY, "side", F.posexplode("entries").alias("at", "gram"))


def on_side(side: int, value: Column | None = None) -> Column:
    """The count of a side's rows, or the sum of their values."""
    return F.sum(F.when(F.col("side") == side, F.lit(1) if value is None else value).otherwise(0))


def _overlaps(pairs: DataFrame, of: Callable[[str], Column], **sums: Column) -> DataFrame:
    """Sums over the distinct grams of each pair; their counts on both sides are a and b."""
    counts = both_sides(pairs, of).groupBy(*KEY, "gram").agg(on_side(0).alias("a"), on_side(1).alias("b"))
    return counts.groupBy(*KEY).agg(*(F.sum(v).alias(k) for k, v in sums.items()))


def gram_overlap_join(pairs: DataFrame, n: int) -> DataFrame:
    """overlap of each pair that shares an n-gram: the sum of the lesser counts."""
    return overlaps(pairs, KEY, n).select(*KEY, F.col(f"overlap{n}").alias("overlap")).filter("overlap > 0")


def gram_intersect_all(pairs: DataFrame, n: int = 1) -> DataFrame:
    """The same as the size of the multiset intersection: all entries less those that one side has more often."""
    more = _overlaps(pairs, lambda c: s.grams(F.col(c), n), every=F.col("a") + F.col("b"), more=F.abs(F.col("a") - F.col("b")))
    return more.select(*KEY, F.expr("(every - more) DIV 2").alias("overlap")).filter("overlap > 0")


def rouge(pairs: DataFrame) -> DataFrame:
    """Recall, precision and F1 for one and two words, which are counted in one pass. Pairs without words have a row too."""
    sides = pairs if "source_clean" in pairs.columns else with_parts(pairs, "st", "ct")
    return with_rouge(overlaps(sides, KEY, 1, 2)).select(*KEY, *ROUGE)


ROUGE = [f"rouge{n}_{c}" for n in (1, 2) for c in ("recall", "precision", "f1")]


def with_rouge(rows: DataFrame) -> DataFrame:
    """The rows with ROUGE, from the words of both sides and the overlaps of one and two words."""
    for n in (1, 2):
        part = lambda words: s.safe_div(F.col(f"overlap{n}"), F.greatest(F.lit(0), F.col(words) - (n - 1)))  # noqa: B023, E731
        rows = rows.withColumns({f"rouge{n}_recall": part("words_source"), f"rouge{n}_precision": part("words_candidate")})
        rows = rows.withColumn(f"rouge{n}_f1", s.f1(F.col(f"rouge{n}_precision"), F.col(f"rouge{n}_recall")))
    return rows


def vocabulary(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select(*KEY, F.explode(F.array_distinct(side)).alias("token"))


def vocab_shared(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY, F.explode(F.array_intersect("ct", "st")).alias("token"))


def vocab_novel(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY, F.explode(F.array_except("ct", "st")).alias("token"))


def vocab_union(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY, F.explode(F.array_union("st", "ct")).alias("token"))


def _vocab(pairs: DataFrame) -> DataFrame:
    """The pairs with vocab_jaccard and novel_vocab_pct. pairs: with the sizes of the vocabularies already, or made here."""
    if "vocab_both" not in pairs.columns:
        both, distinct = F.size(F.array_intersect("st", "ct")), lambda c: F.size(F.array_distinct(c))
        pairs = with_parts(pairs, "st", "ct").withColumns({"vocab_both": both, "vocab_source": distinct("st"), "vocab_candidate": distinct("ct")})
    both, nc = F.col("vocab_both"), F.col("vocab_candidate")
    return pairs.withColumns({"vocab_jaccard": s.safe_div(both, F.col("vocab_source") + nc - both), "novel_vocab_pct": s.safe_div(nc - both, F.greatest(F.lit(1), nc)) * 100})


def vocab_metrics(pairs: DataFrame) -> DataFrame:
    """Jaccard similarity of the vocabularies and the candidate's share of new words."""
    return _vocab(pairs).select(*KEY, "vocab_jaccard", "novel_vocab_pct")


def sentence_shared(pairs: DataFrame) -> DataFrame:
    """(source_id, candidate, sentence): normalised distinct sentences of both sides."""
    return with_parts(pairs, "ss", "cs").select(*KEY, F.explode(F.array_intersect("cs", "ss")).alias("sentence"))


def sentence_overlap(pairs: DataFrame) -> DataFrame:
    """Per cent of the candidate's distinct sentences that the source has."""
    return with_parts(pairs, "ss", "cs").select(*KEY, _sentence_share(*_own_sentences()).alias("sentence_overlap_pct"))


def _own_sentences() -> tuple[Column, Column]:
    return F.size(F.array_intersect("ss", "cs")), F.size("cs")


def _sentence_share(both: Column, sentences: Column) -> Column:
    return s.safe_div(both, F.greatest(F.lit(1), sentences)) * 100


def readability(pairs: DataFrame) -> DataFrame:
    """100 less 4 for each word that the mean distinct sentence is off 16. Of candidates alone."""
    return with_parts(pairs, "cs", "ct").select(*KEY, _readability(F.size("ct"), F.size("cs")).alias("readability_score"))


def _readability(words: Column, sentences: Column) -> Column:
    mean = s.safe_div(words, F.greatest(F.lit(1), sentences))
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(mean - 16) * 4)


def sides(pairs: DataFrame) -> DataFrame:
    """What quality_metrics() needs of each pair beside its alignment, with its tokens st and ct."""
    rows = with_parts(pairs, "st", "ct", "ss", "cs", "chars_source", "chars_candidate")
    rows = rows.withColumns({"sentence_overlap_pct": _sentence_share(*_own_sentences()), "readability_score": _readability(F.size("ct"), F.size("cs"))})
    return rows.select(*KEY, "cand_ord", *(F.col(c).cast("double").alias(c) for c in ("chars_source", "chars_candidate")), "st", "ct", "sentence_overlap_pct", "readability_score")


def clean_sides(pairs: DataFrame) -> DataFrame:
    """The pairs with cleaned texts, from which alignment.counted_texts() counts all that quality_metrics() needs. pairs: with source_clean already, or it is made here."""
    if "source_clean" not in pairs.columns:
        pairs = pairs.withColumn("source_clean", s.clean_source(F.col("source_text")))
    chars = [F.length(f"{c}_text").cast("double").alias(f"chars_{c}") for c in ("source", "candidate")]
    return pairs.select(*KEY, "cand_ord", *chars, "source_clean", s.clean_markdown(F.col("candidate_text")).alias("candidate_clean"))


def with_sentences(counts: DataFrame) -> DataFrame:
    """The rows of alignment.counted_texts() with what follows from their sentences."""
    both, sentences, words = (F.col(c) for c in ("sentences_both", "sentences_candidate", "words_candidate"))
    return counts.withColumns({"sentence_overlap_pct": _sentence_share(both, sentences), "readability_score": _readability(words, sentences)})


def quality_metrics(pairs: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """All metrics of each pair, aligned: (source_id, candidate, equal_words) of the alignment. Without it, pairs have counts of their
    alignment, vocabularies and overlaps already: sides() with alignment.counted(), or with_sentences()."""
    words, names = ("words_source", "words_candidate"), [*KEY, "cand_ord", "chars_source", "chars_candidate"]
    more = ["vocab_jaccard", "novel_vocab_pct", "sentence_overlap_pct", "readability_score"]
    if aligned is None:
        doubles = [F.col(c).cast("double").alias(c) for c in words]
        out = with_rouge(_vocab(pairs)).select(*names, *doubles, *more, *ROUGE, "equal_words")
    else:
        rows = with_parts(pairs, "st", "ct", "ss", "cs", "chars_source", "chars_candidate")
        doubles = [F.size(a).cast("double").alias(b) for a, b in zip(("st", "ct"), words, strict=True)]
        out = _vocab(sides(rows)).select(*names, *doubles, *more).join(rouge(rows), KEY)
        out = out.join(aligned.select(*KEY, "equal_words"), KEY, "left").na.fill(0, ["equal_words"])
    m, a, b = F.col("equal_words"), F.col("words_source"), F.col("words_candidate")
    out = out.withColumns({
        "word_seq_ratio": F.when(a + b == 0, 1.0).otherwise(s.safe_div(m * 2, a + b)),
        "base_words_preserved_pct": s.safe_div(m, a) * 100,
        "candidate_words_aligned_pct": s.safe_div(m, b) * 100,
        "compression_pct": (F.lit(1.0) - s.safe_div(b, a)) * 100,
    })
    kept, less = F.col("base_words_preserved_pct"), F.col("compression_pct")
    return out.withColumns({
        "fidelity_score": kept * 0.30 + F.col("rouge1_recall") * 100 * 0.25 + F.col("rouge2_recall") * 100 * 0.20
        + F.col("word_seq_ratio") * 100 * 0.20 + F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(less) * 2) * 0.05,
        "rewrite_aggressiveness": F.least(F.lit(100.0), (F.lit(100.0) - kept) * 0.6 + F.greatest(F.lit(0.0), less) * 0.3 + F.col("novel_vocab_pct") * 0.1),
    }).drop("equal_words")


def rank_candidates(metrics: DataFrame) -> DataFrame:
    """rank by fidelity within each source, ties in order of the candidates; the leader has rank 1."""
    w = Window.partitionBy("source_id").orderBy(F.desc("fidelity_score"), "cand_ord")
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("leader", F.col("rank") == 1)


def exact_median(rows: DataFrame, key: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(key, p50): the mean of the two middle values (of one, if their number is odd) of each key's values that aren't null. The values
    are numbered by range partitions, so no key is gathered in one task."""
    placed = numbered(rows.filter(F.isnotnull(value)).select(*key, value), key, [value], parts)
    middle = (F.col("rn") == F.floor((F.col("total") + 1) / 2)) | (F.col("rn") == F.floor(F.col("total") / 2) + 1)
    return placed.filter(middle).groupBy(*key).agg(F.avg(value).alias("p50"))


def quality_by_candidate(metrics: DataFrame, parts: int | None = None) -> DataFrame:
    """Mean, least and median fidelity and readability by candidate name, and over all (null name)."""
    names = ("fidelity_score", "readability_score")
    metrics = settled(metrics.select("candidate", *names), "metrics")  # read three times: for the means, the ranges' borders and the medians
    cells = [f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("least", F.min))]
    out = metrics.rollup("candidate").agg(F.grouping("candidate").alias("all"), F.count(F.lit(1)).alias("n"), *cells)
    values = F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names)))
    rows = metrics.select(F.explode(F.array(F.struct(F.lit(0).alias("all"), "candidate"), F.struct(F.lit(1).alias("all"), F.lit(None).cast("string").alias("candidate")))).alias("of"), *names)
    middle = exact_median(rows.select("of.*", values), ["all", "candidate", "metric"], "value", parts)
    middle = middle.groupBy("all", "candidate").agg(*(F.max(F.when(F.col("metric") == c, F.col("p50"))).alias(f"p50_{c}") for c in names))
    same = (out["all"] == middle["all"]) & out["candidate"].eqNullSafe(middle["candidate"])
    return out.join(middle, same, "left").select(out["candidate"], "n", *(f"{n}_{c}" for c in names for n in ("mean", "least", "p50")))


def report_rows(metrics: DataFrame) -> DataFrame:
    """The columns of the report, the two recalls in per cent."""
    return metrics.select(
        *KEY, F.col("fidelity_score").alias("fidelity"), F.col("base_words_preserved_pct").alias("preserved_pct"), "compression_pct",
        (F.col("rouge1_recall") * 100).alias("rouge1_recall_pct"), (F.col("rouge2_recall") * 100).alias("rouge2_recall_pct"),
        F.col("rewrite_aggressiveness").alias("rewrite_pct"), F.col("readability_score").alias("readability"),
    )


def report_top(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates of the corpus."""
    return report_rows(metrics).orderBy(F.desc("fidelity"), "source_id", "candidate").limit(k)
