"""Centroid clustering: the curve, the boxes and whole results against a plain loop."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.llm.centroids import VectorBlocks, candidates, cluster, hilbert_keys, nearest

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("seed", range(5))
def test_candidates_hold_every_nearest(seed):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-50, 50, (16, 6))
    centroids[9] = centroids[2]
    for _ in range(50):
        low = rng.integers(-60, 50, 6)
        high = low + rng.integers(0, 20, 6)
        points = rng.integers(low, high + 1, (200, 6))
        d = ((points[:, None, :] - centroids) ** 2).sum(axis=2)
        near = candidates(low, high, centroids)
        assert set(np.flatnonzero((d == d.min(axis=1)[:, None]).any(axis=0))) <= set(near.tolist())
        at, dist = nearest(points, centroids, near)
        assert at.tolist() == d.argmin(axis=1).tolist() and dist.tolist() == d.min(axis=1).tolist()


def test_large_components_are_exact():
    a, b = np.array([[2**27 - 1] * 64]), np.array([[-(2**27) + 1] * 64, [2**27 - 2] * 64])
    at, d = nearest(a, b, np.array([0, 1]))
    assert at.tolist() == [1] and d.tolist() == [64]
    assert nearest(a, b, np.array([0]))[1].tolist() == [64 * (2**28 - 2) ** 2]


def plainly(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, got, strict=True) if c == n]
            if mine:
                cents[n] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    got = assign()
    total = {n: sum(d for d, c in got if c == n) for n in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, got, strict=True))


def got(df, **more):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster(df, **more).collect())


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(df) == plainly(rows)


def vectors(rng, n, dims, clumps=0):
    base = rng.normal(0, 1, (n, dims))
    if clumps:
        base = rng.normal(0, 4, (clumps, dims))[rng.integers(0, clumps, n)] + base / 20
    return [[float(x) for x in v] for v in base.astype(np.float32)]


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate(vectors(rng, 40, 64)))
    same = vectors(rng, 1, 64)[0]
    rows += [(100 + i, same) for i in range(300)] + [(7, same), (7, rows[3][1]), (None, same), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, same[:63]), (903, [*same, 1.0]), (904, [None, *same[1:]]), (905, [float("nan"), *same[1:]]), (906, [float("inf"), *same[1:]])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("key", F.lit("x")).withColumn("row", F.lit(1)).withColumn("distance", F.lit(0))
    assert got(df) == plainly(rows)


def test_few_and_none(spark):
    rows = list(enumerate(vectors(np.random.default_rng(2), 5, 64)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plainly(rows) and {r[1] for r in got(df)} == set(range(5))
    for none in (df.limit(0), df.select("vec_id", F.slice("embedding", 1, 3).alias("embedding"))):
        assert cluster(none).collect() == [] and cluster(none).columns == cluster(df).columns


def test_wide_components(spark):
    rows = [(i, [x * 300_000 for x in v]) for i, v in enumerate(vectors(np.random.default_rng(4), 30, 64))]
    rows = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)
    with pytest.raises(Exception, match="beyond 64 bits"):
        cluster(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA))


def test_other_dimensions_and_string_ids(spark):
    rows = [(f"v{i}", v) for i, v in enumerate(vectors(np.random.default_rng(6), 60, 3))]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    assert got(df, k=4, rounds=2, dims=3, scale=1000, id_col="name", vec_col="v") == plainly(rows, k=4, rounds=2, dims=3, scale=1000)


def test_boxes_prune_clumped_vectors(spark):
    rows = list(enumerate(vectors(np.random.default_rng(5), 20_000, 64, clumps=20)))
    kept = VectorBlocks(spark.createDataFrame(rows, SCHEMA))
    assert kept.candidate_counts(kept.improve(kept.first_centroids(16), 1)).selectExpr("sum(n_vectors * n_candidates) / sum(n_vectors)").first()[0] < 5
