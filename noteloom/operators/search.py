"""Ranked search over an inverted index whose blocks know their largest term frequencies.

A block has documents of about the same length, which can score alike. For each term and block the index has the largest
frequency, and so for each query and block a bound that no document of the block exceeds. A query reads its most promising blocks
first; the k-th best score there is a floor, and only blocks whose bound reaches it are read. Postings are (block, token)
rows, so a term that all documents have contributes the postings of these blocks only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scalars as s
from noteloom.sources.shared import settled

BLOCK_DOCS = 1024
BLOCK_CHARS = 3_000_000
PART_CHARS = 3_000_000  # of a partition of whole blocks; what their tokens take in memory is some 100 times that
FIRST_BLOCKS = 4  # blocks that a query reads for its floor
OCTAVE = 4  # classes of document sizes to a doubling
DIGITS = 6  # of a score
SENT_ROWS = 200_000  # rows that may be broadcast; more go by a shuffle


def sent(df: DataFrame, name: str) -> DataFrame:
    """df, stored; marked for broadcast if its rows are few."""
    df = settled(df, name)
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


@dataclass
class Index:
    """postings: block, token, hits (array of doc_id, tf); maxima: token, block, most; terms: token, df, n_all, idf; firsts: the smallest doc_ids;
    parts: how many partitions of whole blocks fit in a task's memory."""

    postings: DataFrame
    maxima: DataFrame
    terms: DataFrame
    firsts: DataFrame
    parts: int


def index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS, most_asked: int = 1000) -> Index:
    """docs: doc_id, text. Searches may ask for `most_asked` documents at most. Documents move once, to their blocks; a block has about
    `block_docs` documents and `block_chars` characters at most (or one document)."""
    texts = docs.select("doc_id", "text", F.char_length("text").alias("chars")).filter("chars > 0")
    texts = texts.withColumn("size", F.floor(F.log2(F.col("chars").cast("double")) * OCTAVE).cast("int"))
    classes = texts.groupBy("size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("chars") / block_chars)).alias("salts"), F.sum("chars").alias("chars"))
    classes = settled(classes, "classes")  # at most 31 * OCTAVE rows
    parts = classes.agg(F.ceil(F.sum("chars") / PART_CHARS)).first()[0] or 1  # more texts are more partitions, not larger ones
    placed = texts.join(F.broadcast(classes.drop("chars")), "size")
    placed = placed.select((F.col("size").cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), "salts")).alias("block"), "doc_id", "text").repartition(parts, "block")
    placed = placed.select("block", "doc_id", s.tokens(F.col("text")).alias("tokens"))  # tokens are made where they are needed
    counts = placed.select("block", "doc_id", F.explode("tokens").alias("token")).groupBy("block", "token", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    postings = counts.groupBy("block", "token").agg(F.collect_list(F.struct("doc_id", "tf")).alias("hits"), F.max("tf").alias("most"))  # a block's documents
    postings = settled(postings, "postings")
    maxima = postings.select("token", "block", "most")
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n_all"))  # one row
    idf = postings.groupBy("token").agg(F.sum(F.size("hits")).alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", F.log(F.col("n_all") / F.col("df")))
    firsts = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy("doc_id").limit(most_asked)
    return Index(postings, maxima, settled(idf, "terms"), settled(firsts, "firsts"), parts)


def _scores(known: Index, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of all documents of the given (item_id, block) that have a term of the query."""
    wanted = sent(blocks.join(asked, "item_id").select("item_id", "block", "token", "idf"), "wanted")
    lists = known.postings.join(sent(asked.select("token").distinct(), "asked-tokens"), "token", "left_semi")
    hits = lists.join(wanted, ["block", "token"]).select("item_id", "idf", F.inline("hits")).groupBy("item_id", "doc_id")
    return hits.agg(F.round(F.sum(F.col("tf") * F.col("idf")), DIGITS).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def promising(known: Index, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores of each query's first blocks, and the further blocks (item_id, block) that may hold one of the k best. asked: item_id, token, idf."""
    bounds = known.maxima.join(sent(asked, "bounded"), "token").groupBy("item_id", "block").agg((F.sum(F.col("most") * F.col("idf"))).alias("bound"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "block"))
    bounds = settled(bounds.withColumn("first", place <= FIRST_BLOCKS), "bounds")
    found = settled(_scores(known, asked, bounds.filter("first").select("item_id", "block")), "first-scores")
    floor = _best(found, k).filter(F.col("rank") == k).select("item_id", F.col("score").alias("floor"))
    rest = bounds.filter("NOT first").join(floor, "item_id", "left")
    return found, rest.filter(F.isnull("floor") | (F.col("bound") >= F.col("floor") - 10.0**-DIGITS)).select("item_id", "block")


def search(known: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, doc_id, score, rank): the k best documents of each query (item_id, text) by the sum of tf * idf over its distinct
    terms, rounded; ties by doc_id. Terms that all documents have weigh nothing, so they only matter where fewer than k
    documents have another one: then the smallest ids follow with score 0."""
    asked = queries.select("item_id", F.explode(F.array_distinct(s.tokens(F.col("text")))).alias("token")).distinct()
    asked = settled(known.terms.select("token", "idf").join(sent(asked, "query-terms"), "token"), "query-terms")
    weighty = asked.filter("idf > 0")
    found, rest = promising(known, weighty, k)
    scores = found.unionByName(_scores(known, weighty, rest))
    everywhere = asked.filter("idf = 0").select("item_id").distinct().crossJoin(F.broadcast(known.firsts.orderBy("doc_id").limit(2 * k)))  # 2 * k rows
    scores = scores.unionByName(everywhere.select("item_id", "doc_id", F.lit(0.0).alias("score")))
    return _best(scores.groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), k)
