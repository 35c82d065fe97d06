"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors of equal components are one class. A class has a unit vector x = s * q + e: q are int8 codes, s is its scale, and
|e| is computed, not estimated. For two classes |x.y - s t q.r| <= |e| + |f| + |e| |f|, so the product of the codes decides
every pair but those within that bound of the threshold.

1. Classes are dealt to blocks by a hash, and each pair of blocks is a group that gets the codes of both: 8 bits a
   component travel, no vectors. A group multiplies tile by tile (sums of int8 products are exact in float32), counts the
   partners that are surely near, keeps a spanning forest of these links, and names the vectors that are in an undecided pair.
2. Groups with undecided pairs get the full vectors of what they named, find these pairs again by the codes, and
   compute them in double precision.
3. Counts are summed by class, forests are joined to components.

A group's result has at most three rows per vector of its blocks, however many pairs are near: pairs never leave a task.
Work grows with the square of the classes, as the method asks; the rows that travel grow with classes * blocks, and blocks
grow up to MOST_BLOCK classes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of different length don't link; equal vectors and repeated rows link with each other (all rows
that share the smallest id are kept); a row with null id links as any other but names a component only if all its ids are
null; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import stored, table
from noteloom.llm.near_dedup import labelled

THRESHOLD = 0.9
BLOCKS = 12  # at least so many blocks, for parallel groups
LEAST_BLOCK, MOST_BLOCK = 512, 32_768  # classes of a block
TILE = 1024
EXACT_COLUMNS = 1024  # 1024 * 127 * 127 < 2 ** 24
SLACK = 1e-9  # for the rounding of the bounds and of the scaled products
PAIRS = 65_536  # full-precision products at a time


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error norms of the rows of x, which aren't zero."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # by a power of two: squares stay in range
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    rest = x - codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + SLACK) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two code matrices."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= EXACT_COLUMNS else np.float64)
    for k in range(0, a.shape[1], EXACT_COLUMNS):
        out += a[:, k : k + EXACT_COLUMNS].astype(np.float32) @ b[:, k : k + EXACT_COLUMNS].astype(np.float32).T
    return out


class Side:
    """The classes of one block in a group, in order of their scales, so that a tile's scales are alike."""

    def __init__(self, ids, weights, codes, scale, error):
        order = np.argsort(scale, kind="stable")
        self.ids, self.weights, self.codes, self.scale, self.error = ids[order], weights[order], codes[order], scale[order], error[order]
        self.order = order

    def tiles(self):
        return range(0, len(self.ids), TILE)


def possible(a: Side, b: Side, threshold: float):
    """Yields (i, j, product, bound) of the pairs of each tile that may reach the threshold; of one block with itself each pair once."""
    for p in a.tiles():
        rows = slice(p, p + TILE)
        for q in b.tiles():
            if a is b and q < p:
                continue
            cols = slice(q, q + TILE)
            d = products(a.codes[rows], b.codes[cols])
            ea, eb = a.error[rows].max(), b.error[cols].max()
            low = (threshold - ea - eb - ea * eb - SLACK) / (a.scale[rows].max() * b.scale[cols].max())
            i, j = np.nonzero(d >= np.float32(low * (1 - 1e-6)) if low > 0 else np.ones_like(d, bool))
            near = d[i, j].astype(np.float64)
            i, j = i + p, j + q
            if a is b:
                once = i < j
                i, j, near = i[once], j[once], near[once]
            near *= a.scale[i] * b.scale[j]
            bound = a.error[i] + b.error[j] + a.error[i] * b.error[j] + SLACK
            may = near + bound >= threshold
            if may.any():
                yield i[may], j[may], near[may], bound[may]


class Forest:
    """Components of the classes of a group, of which only a star for each is told."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[i], self.label[j]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        moved = np.arange(len(self.label))
        for x in list(up):
            moved[x] = top(x)
        self.label = moved[self.label]


def _sides(pdf: pd.DataFrame, codes, scale, error) -> tuple[Side, Side]:
    ids, weights, block = pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
    make = lambda at: Side(ids[at], weights[at], codes[at], scale[at], error[at])
    left = make(np.flatnonzero(block == block.min()))
    return left, left if block.min() == block.max() else make(np.flatnonzero(block != block.min()))


def _told(a: Side, b: Side, found, undecided=None) -> pd.DataFrame:
    """The group's rows: sums of partners, stars of its forest, undecided vectors. found: iterable of (i, j) that are near."""
    ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
    weights = a.weights if a is b else np.concatenate([a.weights, b.weights])
    shift = 0 if a is b else len(a.ids)
    forest, sums = Forest(len(ids)), np.zeros(len(ids), np.int64)
    for i, j in found:
        j = j + shift
        np.add.at(sums, i, weights[j])
        np.add.at(sums, j, weights[i])
        forest.join(i, j)
    star = np.flatnonzero(forest.label != np.arange(len(ids)))
    some = np.flatnonzero(sums)
    open_ = np.flatnonzero(undecided) if undecided is not None else np.zeros(0, int)
    return pd.DataFrame({
        "kind": np.repeat(["sum", "link", "open"], [len(some), len(star), len(open_)]),
        "cid": np.concatenate([ids[some], ids[star], ids[open_]]),
        "other": np.concatenate([ids[some], ids[forest.label[star]], ids[open_]]),
        "n": np.concatenate([sums[some], np.zeros(len(star) + len(open_), np.int64)]),
    })


TOLD = "dim int, i int, j int, kind string, cid long, other long, n long"


def _by_codes(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(len(pdf), -1)
        a, b = _sides(pdf, codes, pdf["scale"].to_numpy(), pdf["error"].to_numpy())
        shift = 0 if a is b else len(a.ids)
        undecided = np.zeros(shift + len(b.ids), bool)

        def sure():
            for i, j, near, bound in possible(a, b, threshold):
                is_sure = near - bound >= threshold
                undecided[i[~is_sure]] = undecided[j[~is_sure] + shift] = True
                yield i[is_sure], j[is_sure]

        return _told(a, b, sure(), undecided).assign(dim=key[0], i=key[1], j=key[2])[["dim", "i", "j", "kind", "cid", "other", "n"]]

    return run


def _by_vectors(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_list()).astype(np.float64)
        a, b = _sides(pdf, *quantised(x))
        scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        norm, block = np.sqrt((scaled * scaled).sum(axis=1)), pdf["block"].to_numpy()
        of = lambda side, at: np.flatnonzero(at)[side.order]
        left, right = of(a, block == block.min()), of(b, block == block.max())

        def exact():
            for i, j, near, bound in possible(a, b, threshold):
                at = np.flatnonzero(near - bound < threshold)
                for k in range(0, len(at), PAIRS):
                    some = at[k : k + PAIRS]
                    p, q = left[i[some]], right[j[some]]
                    cosine = (scaled[p] * scaled[q]).sum(axis=1) / (norm[p] * norm[q])
                    yield i[some][cosine >= threshold], j[some][cosine >= threshold]

        return _told(a, b, exact()).assign(dim=key[0], i=key[1], j=key[2])[["dim", "i", "j", "kind", "cid", "other", "n"]]

    return run


def _codes(batches):
    for pdf in batches:
        for _, part in pdf.groupby("dim"):
            codes, scale, error = quantised(np.stack(part["v"].to_list()).astype(np.float64))
            yield part[["cid", "n", "dim", "block"]].assign(codes=[x.tobytes() for x in codes], scale=scale, error=error)


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding). block: classes of a block, or None."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    # a - a = 0 only of finite numbers
    fine = (F.size("v") > 0) & F.forall("v", lambda a: F.coalesce(a - a == 0, F.lit(False))) & F.exists("v", lambda a: a != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v")))
    classes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.select("v", "first", "n", F.monotonically_increasing_id().alias("cid")), "classes")
    many = classes.count()
    size = block or min(MOST_BLOCK, max(LEAST_BLOCK, -(-many // BLOCKS)))
    blocks = max(1, -(-many // size))
    dealt = classes.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")})
    codes = dealt.select("cid", "n", "dim", "block", "v").mapInPandas(_codes, "cid long, n long, dim int, block int, codes binary, scale double, error double")
    codes = stored(codes, "codes")
    meets = codes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meets = meets.withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k")
    first = stored(meets.groupBy("dim", "i", "j").applyInPandas(_by_codes(threshold), TOLD), "by-codes")
    again = first.filter("kind = 'open'").select("i", "j", "cid").join(dealt.select("cid", "n", "dim", "block", "v"), "cid")
    second = stored(again.groupBy("dim", "i", "j").applyInPandas(_by_vectors(threshold), TOLD), "by-vectors")

    told = first.unionByName(second)
    sums = told.filter("kind = 'sum'").groupBy("cid").agg(F.sum("n").alias("others"))
    comps = labelled(told.filter("kind = 'link'").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    named = classes.join(comps.withColumnRenamed("cls", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(sums, "cid", "left")
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(least, "comp").select("v", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.isnull("v"), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP11_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
 r AS (SELECT a AS vec_id, b AS c FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
 n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
 FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""


def op11_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))
