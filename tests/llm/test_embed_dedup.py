import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import embed_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.9):
    """vec_id -> (n_links, component_id) by comparing all pairs in double precision. rows: (vec_id, vector or None)."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, links = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(good):
        for j, y in good[k + 1 :]:
            if len(x) == len(y) and (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (links[i], top(i)) for i in up}


def result(df, **kw):
    rows = ed.near_dedup(df, **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert result(df) == plain([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize(("dim", "block"), [(3, 40), (8, 1000), (1500, 64)])
def test_pairs_at_all_distances_from_the_threshold(spark, dim, block):
    """In few dimensions many cosines lie within the error bounds, so both passes decide pairs."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(240, dim)) * 10.0 ** r.integers(-12, 12, size=(240, 1))
    if dim > 100:
        x[120:] = x[:120] / np.linalg.norm(x[:120], axis=1)[:, None] + r.normal(size=(120, dim)) * 0.484 / np.sqrt(dim)
    x[-6:] = x[0]
    rows = [(i * 3 + 1, [float(v) for v in np.float32(row)], 0) for i, row in enumerate(x)]
    assert result(spark.createDataFrame(rows, SCHEMA), block=block) == plain([(i, v) for i, v, _ in rows])


def test_bounds_hold_and_codes_alone_decide_most():
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 64))
    codes, scale, error = ed.quantised(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    off = np.abs(unit @ unit.T - ed.products(codes, codes) * scale[:, None] * scale[None, :])
    assert (off <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-12).all()
    assert error.max() < 0.01


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, [1.0, 2.0], 1), (3, [2.0, 4.0], 1), (3, [1.0, 2.0], 1), (9, None, 1), (10, [], 1), (11, [0.0, 0.0], 1), (12, [1.0, None], 1), (13, [nan, 1.0], 1), (14, [inf, 1.0], None),
            (15, [1.0, 2.0, 0.0], 1), (16, [-0.0, 5.0], 1), (17, [0.0, 5.0], 1), (18, [3e38, 3e38], 1), (19, [1e-38, 1e-38], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cid": F.lit(1), "v": F.lit("x"), "n": F.lit(2)})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_dedup(df).collect())
    linked = {3: 4, 7: 4, 18: 3, 19: 3}
    assert [x[:2] for x in got if x[0] in (9, 10, 11, 12, 13, 14, 15)] == [(k, 0) for k in (9, 10, 11, 12, 13, 14, 15)]
    # (1, 2), (2, 4) and the two of equal direction (1, 1): cosine 0.9487; (0, 5) and (1, 2): 0.894
    assert [x for x in got if x[0] in linked] == [(3, 4, 3, True), (3, 4, 3, True), (7, 4, 3, False), (18, 4, 3, False), (19, 4, 3, False)]
    assert [x for x in got if x[0] in (16, 17)] == [(16, 1, 16, True), (17, 1, 16, False)]
    null = ed.near_dedup(spark.createDataFrame([(None, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (None, [0.0], 0)], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in null) == [("5", 1, "5", True), ("None", 0, "None", True), ("None", 1, "5", False)]
    assert ed.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
