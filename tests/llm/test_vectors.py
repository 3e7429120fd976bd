import numpy as np
import plain
from pyspark.sql import functions as F

from riskweave.llm import vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, cosine):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    groups = plain.Groups()
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.join(ids[a], ids[b])
    return {i: (int(n), groups.find(i)) for i, n in zip(ids, near.sum(axis=1), strict=True)}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_SIZE", 32)
    monkeypatch.setattr(vectors, "BLOCK", 40)  # lists and searches in several blocks
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 20))
    x = np.concatenate([centre + s * rng.normal(size=centre.shape) for s in (0, 0.1, 0.2, 0.3, 0.4, 0.5)])
    x = np.concatenate([x, rng.normal(size=(200, 20)), 3 * x[:30], np.repeat(x[:1], 100, axis=0)]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(x)) * 3 + 1]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit(1)).withColumn("unit", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_classes(df, spread=None).collect()}
    assert got == brute(ids, x.astype(np.float64), 0.9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]),
        (2, [5.0, 0.0]),
        (3, [0.0, 0.0]),
        (4, None),
        (5, [nan, 1.0]),
        (6, [inf, 1.0]),
        (7, [None, 1.0]),
        (None, [1.0, 0.0]),
        (9, [1e-30, 0.0]),
        (9, [1e-30, 0.0]),
        (10, [-1.0, -0.0]),
    ]
    out = vectors.vector_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(map(tuple, out), key=repr)
    linked = [(1, 2, 1, True), (2, 2, 1, False), (9, 2, 1, False), (9, 2, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10)]
    assert got == sorted([*linked, *alone, (None, 0, None, False)], key=repr)
    assert vectors.vector_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = vectors.vector_classes(spark.createDataFrame([(1, None)], SCHEMA)).collect()
    assert [tuple(r) for r in nothing] == [(1, 0, 1, True)]


def test_codes_bound_the_distance():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = vectors.fit(x[:300].astype(np.float32), 600)
    assert q.books.shape[:2] == (vectors.SUBSPACES, vectors.CODES)
    a, b = x[:300], x[300:]
    own, other = (q.coarse[vectors._nearest(p.astype(np.float32), q.coarse)] for p in (a, b))
    apart = np.linalg.norm(a - b, axis=1)
    behind = vectors._behind(a, own, other) + vectors._behind(b, other, own)
    assert (behind <= apart + 1e-6).all()


def test_production_reach_on_few_strong_directions(spark):
    rng = np.random.default_rng(9)
    # 4,000 vectors for 15 lists
    x = rng.normal(size=(4000, 64)) * np.arange(1, 65) ** -1.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.vector_classes(df).collect()}
    assert got == dict(enumerate(n.tolist()))


def test_recall_beyond_the_measured_vectors(spark):
    # links of vectors whose id 100 divides, of 12,000 with few strong directions, of which 2,048 are measured
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6000, 48)) * np.arange(1, 49) ** -1.0
    x = np.concatenate([base, base + 0.25 * rng.normal(size=base.shape) * np.arange(1, 49) ** -1.0])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (unit[::100] @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.vector_classes(df).where("vec_id % 100 = 0").collect()}
    found = np.array([got[i] for i in range(0, len(x), 100)])
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum() and n.sum() > 100


def test_lists_grow_with_the_vectors():
    assert [vectors.lists_for(n) for n in (10, 51200, 131072, 1 << 20, 1 << 30)] == [1, 200, 512, 2048, 65536]
