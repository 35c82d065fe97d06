"""Soft-membership mixing to target weights (DataFrame functions only).

Domains are the classes of a labelled table: language and quality. A naive Bayes classifier over hashed
words, fitted on a bounded sample of labelled rows, gives every document posteriors over the domains.
Document rates r >= least then solve a least-squares problem: the expected tokens of each domain,
sum of r * tokens * posterior, are to match the targets. It is solved by projected gradient. The gradient
of a document depends on the domains' residuals alone, so an iteration is one aggregation to as many
numbers as there are domains; the weighting by the inverse moment matrix of the posteriors makes a
step exact wherever no rate is at its bound, so few iterations are needed.

Words are what ASCII white space separates. They are counted by saturation: n words weigh as n * EVIDENCE / (n + EVIDENCE), which keeps memberships
soft in long texts.

Defined results: null or empty texts have no tokens, the domains' shares as posteriors, and a rate like
any; repeated rows are rated alike, each by itself; each row of a labelled id teaches once, all the domain that is
first by name; null ids are allowed; labelled rows whose domain is
null or unknown aren't learned from; without any labelled row posteriors are even; an empty table gives
an empty result; clashing column names don't matter.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import stored, table

SLOTS = 4096
MOST_LABELLED = 6000
EVIDENCE = 60.0
ITERATIONS = 40
# Target weights of the domains, language and quality; they sum to 1.
WEIGHTS = {
    "en:1": 0.40, "de:1": 0.15, "fr:1": 0.15, "es:1": 0.15,
    "en:0": 0.06, "de:0": 0.03, "fr:0": 0.03, "es:0": 0.03,
}


def word_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per word of each row of docs (one with a null slot if it has none), with its hashed slot."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    numbered = docs.select(*keep, "text").withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("row", *keep, F.explode_outer(words).alias("word"))
    return rows.withColumn("slot", F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64("word"), F.lit(SLOTS)).cast("int"))).drop("word")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return docs.join(known, "doc_id").select("doc_id", F.concat_ws(":", F.col("lang"), F.col("q").cast("string")).alias("domain"))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = MOST_LABELLED) -> tuple[DataFrame, list[float]]:
    """Weights (slot, w0, w1, ...) of SLOTS rows, and the log prior of each domain. At most `most` labelled ids are read."""
    ids = labelled.filter(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counts = word_rows(own, "domain").filter("slot IS NOT NULL").groupBy("slot").agg(
        *(F.sum(F.when(F.col("domain") == d, 1.0).otherwise(0.0)).alias(f"c{k}") for k, d in enumerate(domains))
    )
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    counts = stored(every.join(counts, "slot", "left").na.fill(0.0), "slots")
    sums = counts.agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(len(domains)))).first()
    logs = [F.log((F.col(f"c{k}") + 0.5) / (sums[k] + 0.5 * SLOTS)) for k in range(len(domains))]
    middle = sum(logs[1:], logs[0]) / len(domains)
    weights = stored(counts.select("slot", *((x - middle).alias(f"w{k}") for k, x in enumerate(logs))), "weights")
    seen = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(seen.values()) + len(domains)
    return weights, [float(np.log((seen.get(d, 0) + 1) / whole)) for d in domains]


def posteriors(docs: DataFrame, weights: DataFrame, prior: list[float]) -> DataFrame:
    """doc_id, key (hash of id and text), n_tokens and p (one posterior for each domain) of each row of docs."""
    k = len(prior)
    rows = word_rows(docs.withColumn("key", F.xxhash64("doc_id", "text")), "doc_id", "key").join(F.broadcast(weights), "slot", "left")
    sums = rows.groupBy("row", "doc_id", "key").agg(F.count("slot").alias("n_tokens"), *(F.avg(f"w{i}").alias(f"m{i}") for i in range(k)))
    weight = F.col("n_tokens") * EVIDENCE / (F.col("n_tokens") + EVIDENCE)
    logits = [F.coalesce(F.col(f"m{i}"), F.lit(0.0)) * weight + prior[i] for i in range(k)]
    sums = sums.select("doc_id", "key", "n_tokens", F.array(*logits).alias("logits"))
    exps = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    sums = sums.select("doc_id", "key", "n_tokens", exps.alias("exps"))
    total = F.aggregate("exps", F.lit(0.0), lambda a, x: a + x)
    return sums.select("doc_id", "key", "n_tokens", F.transform("exps", lambda x: x / total).alias("p"))


def _dot(values: list[float]) -> Column:
    out = F.lit(0.0)
    for i, v in enumerate(values):
        out = out + F.col("p")[i] * F.lit(float(v))
    return out


def totals(rated: DataFrame, k: int) -> np.ndarray:
    """Expected tokens of each domain at the present rates."""
    row = rated.agg(*(F.coalesce(F.sum(F.col("r") * F.col("n_tokens") * F.col("p")[i]), F.lit(0.0)) for i in range(k))).first()
    return np.array(row, float)


def solve_rates(members: DataFrame, targets: np.ndarray, least: float = 0.0, tolerance: float = 1e-6) -> DataFrame:
    """members with r: rates of at least `least` whose expected totals match targets as nearly as possible, starting at 1.

    Steps go on until the targets are met within the tolerance or, after ITERATIONS steps, until a step no longer brings the totals nearer:
    then rates at their bound keep them from the targets, and totals() says how near they are.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = members.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)) for i, j in pairs)).first()
    moment = np.zeros((k, k))
    for (i, j), v in zip(pairs, sums, strict=True):
        moment[i, j] = moment[j, i] = v
    scale = max(float(targets.sum()), 1.0)
    weigh = np.linalg.inv(moment + np.eye(k) * scale * 1e-9)
    rated, before = members.withColumn("r", F.lit(max(1.0, least))), np.inf
    for step in count():
        residual = totals(rated, k) - targets
        size = float(residual @ weigh @ residual)  # what projected steps make smaller
        if np.abs(residual).max() <= tolerance * scale or (step >= ITERATIONS and size > before * 0.99):
            break  # met, or as near as nonnegative rates come
        before = size
        rated = rated.withColumn("r", F.greatest(F.lit(least), F.col("r") - _dot(list(weigh @ residual))))
        if step % 4 == 3:
            rated = stored(rated, "rates")
    return rated


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, smoothing: float | None = None, domains: list[str] | None = None) -> DataFrame:
    """doc_id, key, n_tokens, domain (the likeliest), membership (its posterior), rate and copies of each row of docs.

    With `weights` the mix has as many tokens as docs. With `smoothing` the weights are the domains' own
    shares raised to that power, and the mix is as large as needed to keep every document at least once.
    copies is the rate rounded down or up at random (by a hash of id and text), so its mean is the rate.
    """
    names = list(weights or domains or WEIGHTS)
    table_, prior = classifier(docs, labelled, names)
    members = stored(posteriors(docs, table_, prior), "members")
    have = totals(members.withColumn("r", F.lit(1.0)), len(names))
    if smoothing is None:
        least, targets = 0.0, have.sum() * np.array([(weights or WEIGHTS)[d] for d in names])
    else:
        share = np.power(have / max(have.sum(), 1.0), smoothing)
        share = share / max(share.sum(), 1e-12)
        least, targets = 1.0, share * max((h / s for h, s in zip(have, share, strict=True) if s > 0), default=0.0)
    rated = solve_rates(members, targets, least)
    top = F.array_max("p")
    coin = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("r") + (coin < F.col("r") - F.floor("r")).cast("long")
    names_ = F.array(*map(F.lit, names))
    return rated.select(
        "doc_id", "key", "n_tokens", names_[F.array_position("p", top).cast("int") - 1].alias("domain"), top.alias("membership"),
        F.col("r").alias("rate"), copies.cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, labelled: DataFrame, smoothing: float = 0.8) -> DataFrame:
    """The rows of docs, each as often as the mix has it (once at least), with their columns as they were."""
    key, copies = (name + "_" * (1 + max((len(c) for c in docs.columns), default=0)) for name in ("key", "copies"))  # names that docs doesn't have
    often = mix(docs, labelled, smoothing=smoothing).groupBy(F.col("key").alias(key)).agg(F.max("copies").alias(copies))
    rows = docs.join(often, F.xxhash64(docs["doc_id"], docs["text"]) == often[key])
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), WEIGHTS).drop("key")
