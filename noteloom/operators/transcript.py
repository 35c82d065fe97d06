"""Words of a transcript to captions, SRT text and time sections. Every window and group is keyed by lecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.sources.shared import settled

CAPTION_WORDS = 7
CHUNK_SECONDS = 1200.0
# Fillers of one and two words.
FILLERS = ["the", "of", "en", "und"]
FILLER_PAIRS = ["de la", "of the", "in the"]


def word_filter(words: DataFrame) -> DataFrame:
    """Words that have text and both times."""
    return words.filter((s.strip(F.col("word")) != "") & F.col("start_local").isNotNull() & F.col("end_local").isNotNull())


def chunk_offset(words: DataFrame, seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Times from the lecture's start, from times within a chunk."""
    shift = F.col("chunk_no") * F.lit(seconds)
    return words.withColumns({"start_s": shift + F.col("start_local"), "end_s": shift + F.col("end_local")}).drop("start_local", "end_local")


def word_order(words: DataFrame) -> DataFrame:
    """rn: place by start; ties keep the order of arrival (chunk, position)."""
    return words.withColumn("rn", F.row_number().over(Window.partitionBy("lecture_id").orderBy("start_s", "chunk_no", "pos")))


def caption_index(words: DataFrame, size: int = CAPTION_WORDS) -> DataFrame:
    """caption_no: words in order, `size` to a caption."""
    return word_order(words).withColumn("caption_no", (F.floor((F.col("rn") - 1) / size) + 1).cast("long"))


def caption_build(words: DataFrame, size: int = CAPTION_WORDS) -> DataFrame:
    """Captions: start of the first word, end of the last word in order, text of the words that aren't blank."""
    text = F.expr("listagg(nullif(trim(word), ''), ' ') WITHIN GROUP (ORDER BY rn)")
    return caption_index(words, size).groupBy("lecture_id", "caption_no").agg(
        F.min_by("start_s", "rn").alias("start_s"), F.max_by("end_s", "rn").alias("end_s"), F.coalesce(text, F.lit("")).alias("text")
    )


def caption_block(captions: DataFrame) -> DataFrame:
    """block: a caption as it stands in SRT."""
    block = F.concat(
        F.col("caption_no").cast("string"), F.lit("\n"), s.format_tc(F.col("start_s")), F.lit(" --> "), s.format_tc(F.col("end_s")), F.lit("\n"), F.col("text")
    )
    return captions.withColumn("block", block)


def srt_assemble(captions: DataFrame) -> DataFrame:
    """lecture_id and srt: all captions as one text."""
    srt = F.expr("listagg(block, '\n\n') WITHIN GROUP (ORDER BY caption_no)")
    return caption_block(captions).groupBy("lecture_id").agg(s.strip(srt).alias("srt"))


def split_fixed(captions: DataFrame, seconds: float = 300.0) -> DataFrame:
    """Sections of at most `seconds` by the start of captions; the end is that of the last caption."""
    w = Window.partitionBy("lecture_id").orderBy("slot")
    return (
        captions.withColumn("slot", F.floor(F.col("start_s") / seconds))
        .groupBy("lecture_id", "slot")
        .agg(F.min("start_s").alias("start_s"), F.max_by("end_s", "caption_no").alias("end_s"))
        .withColumn("section_no", (F.row_number().over(w) - 1).cast("int"))
        .drop("slot")
    )


def block_similarity(captions: DataFrame, block: int = 4) -> DataFrame:
    """Cosine of the token counts of neighbouring blocks of captions: (lecture_id, block_no, sim) for each block but the first."""
    bags = (
        captions.withColumn("block_no", F.floor((F.col("caption_no") - 1) / block).cast("long"))
        .select("lecture_id", "block_no", F.explode(s.tokens(F.col("text"))).alias("token"))
        .groupBy("lecture_id", "block_no", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bags = settled(bags, "bags")
    norms = bags.groupBy("lecture_id", "block_no").agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    before = bags.select("lecture_id", (F.col("block_no") + 1).alias("block_no"), "token", F.col("n").alias("n0"))
    dots = bags.join(before, ["lecture_id", "block_no", "token"]).groupBy("lecture_id", "block_no").agg(F.sum(F.col("n") * F.col("n0")).alias("dot"))
    prior = norms.select("lecture_id", (F.col("block_no") + 1).alias("block_no"), F.col("sq").alias("sq0"))
    return (
        norms.join(prior, ["lecture_id", "block_no"])
        .join(dots, ["lecture_id", "block_no"], "left")
        .select("lecture_id", "block_no", (F.coalesce("dot", F.lit(0)) / F.sqrt(F.col("sq") * F.col("sq0"))).alias("sim"))
    )


def topic_boundaries(captions: DataFrame, block: int = 4) -> DataFrame:
    """Topic boundaries by lexical cohesion: blocks whose similarity to the one before is a local minimum, and
    whose depth below the peaks at both sides exceeds the lecture's mean less half a standard deviation."""
    sims = settled(block_similarity(captions, block), "similarities")
    w = Window.partitionBy("lecture_id").orderBy("block_no")
    left, right = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    depth = F.max("sim").over(left) + F.max("sim").over(right) - F.col("sim") * 2
    deep = sims.withColumn("depth", F.round(depth, 9)).withColumn("before", F.lag("sim").over(w)).withColumn("after", F.lead("sim").over(w))
    stats = deep.groupBy("lecture_id").agg(F.round(F.avg("depth") - F.stddev_pop("depth") / 2, 9).alias("least"))
    low = (F.col("sim") <= F.coalesce("before", F.lit(2.0))) & (F.col("sim") <= F.coalesce("after", F.lit(2.0)))
    return deep.join(stats, "lecture_id").select("lecture_id", "block_no", "depth", (low & (F.col("depth") > F.col("least"))).alias("boundary"))


def split_lexical(captions: DataFrame, block: int = 4, seconds: float = 300.0) -> DataFrame:
    """(lecture_id, section_no, start_s, end_s): a section begins where a topic does, and again within long topics, every
    `seconds` from the topic's start. None is longer: a last caption that reaches beyond is cut there."""
    captions = settled(captions, "captions")  # read several times
    cuts = topic_boundaries(captions, block).filter("boundary").select("lecture_id", "block_no", F.lit(1).alias("cut"))
    rows = captions.withColumn("block_no", F.floor((F.col("caption_no") - 1) / block).cast("long")).join(cuts, ["lecture_id", "block_no"], "left")
    w = Window.partitionBy("lecture_id").orderBy("caption_no")
    begins = F.when(F.isnotnull("cut") & ~F.coalesce(F.lag("block_no").over(w) == F.col("block_no"), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("begins", begins).withColumn("topic", F.sum("begins").over(w))
    begun = F.min("start_s").over(Window.partitionBy("lecture_id", "topic"))
    parts = rows.withColumn("part", F.floor((F.col("start_s") - begun) / seconds)).groupBy("lecture_id", "topic", "part")
    parts = parts.agg(F.min("start_s").alias("start_s"), F.max_by("end_s", "caption_no").alias("end_s"))
    number = F.row_number().over(Window.partitionBy("lecture_id").orderBy("topic", "part")) - 1
    return parts.select("lecture_id", number.cast("int").alias("section_no"), "start_s", F.least("end_s", F.col("start_s") + seconds).alias("end_s"))


def filler_clean(words: DataFrame, fillers: list[str] = FILLERS, pairs: list[str] = FILLER_PAIRS) -> DataFrame:
    """Words without fillers (of one and two words) and without immediate repeats."""
    w = Window.partitionBy("lecture_id").orderBy("rn")
    low = F.lower(F.col("word"))
    marked = word_order(words).withColumn("low", low)
    pair = lambda a, b: F.concat(a, F.lit(" "), b).isin(pairs)
    after, before = F.lead("low").over(w), F.lag("low").over(w)
    marked = marked.withColumns({"starts": F.coalesce(pair(F.col("low"), after), F.lit(False)), "ends": F.coalesce(pair(before, F.col("low")), F.lit(False)), "prior": before})
    keep = ~F.col("starts") & ~F.col("ends") & ~F.col("low").isin(fillers) & ~F.coalesce(F.col("low") == F.col("prior"), F.lit(False))
    return marked.filter(keep).select("lecture_id", "rn", "word")


def deletions(word: Column, most: int) -> Column:
    """The distinct strings that are left of a word when up to `most` of its letters are deleted."""
    rest = F.array(word)
    for _ in range(most):
        less = F.transform(rest, lambda x: F.transform(F.sequence(F.lit(0), F.char_length(x)), lambda k: F.concat(F.left(x, k), F.substr(x, k + 2))))
        rest = F.array_distinct(F.concat(rest, F.flatten(less)))
    return rest


def glossary_fix(words: DataFrame, glossary: DataFrame, most: int = 2) -> DataFrame:
    """(word, fixed) of each distinct word: the glossary's term within `most` edits if one is nearest, `[?: ...]` on a tie. A
    term begins with the word's first letter.

    Two words within `most` edits have a string in common that deleting up to `most` letters of each leaves, so words and terms are
    joined by these strings and the distance of those that meet is measured. Words longer than any term can match aren't expanded.
    """
    distinct = words.select(F.lower("word").alias("word")).distinct()
    terms = glossary.select(F.lower("term").alias("term")).distinct()
    longest = terms.agg((F.coalesce(F.max(F.char_length("term")), F.lit(0)) + most).alias("longest"))  # one row
    left = lambda c: F.explode(deletions(F.substr(F.col(c), F.lit(2)), most))  # noqa: E731  the first letter stays
    spread = lambda df, c: df.select(c, F.left(F.col(c), F.lit(1)).alias("letter"), left(c).alias("rest"))
    close = spread(distinct.crossJoin(F.broadcast(longest)).filter(F.char_length("word") <= F.col("longest")), "word").join(spread(terms, "term"), ["letter", "rest"])
    close = close.select("word", "term").distinct().withColumn("d", F.levenshtein("word", "term", most)).filter("d >= 0")
    best = close.groupBy("word").agg(F.min(F.struct("d", "term")).alias("best"), F.min("d").alias("d"))
    ties = close.groupBy("word", "d").agg(F.count(F.lit(1)).alias("n"))
    found = best.join(ties, ["word", "d"]).select("word", "n", F.col("best.term").alias("term"))
    fixed = F.when(F.col("n") == 1, F.col("term")).when(F.col("n") > 1, F.concat(F.lit("[?: "), F.col("word"), F.lit("]"))).otherwise(F.col("word"))
    return distinct.join(found, "word", "left").select("word", fixed.alias("fixed"))
