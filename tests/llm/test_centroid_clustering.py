"""Clusters against a plain version in integers, with ties, repeats and vectors that do not count."""

import hashlib
import math

import numpy as np
import pytest

from pulsegrid.llm import centroid_clustering
from pulsegrid.llm.common import prepare


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds if centroids else 0):
        label = [nearest(v)[1] for _, v in kept]
        for n in set(label):
            own = [v for (_, v), x in zip(kept, label, strict=True) if x == n]
            centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept] if centroids else []
    inertia = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found]


def vectors(n, dims, seed):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + random_.normal(size=dims) * 0.3).round(2).tolist()) for i in range(n)]
    return rows + [(rows[-1][0], rows[-1][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, [0.5] * (dims - 1)), (n + 4, [None] + [0.5] * (dims - 1)), (n + 5, [math.nan] * dims), (n + 6, [math.inf] * dims), (None, [0.25] * dims)]


@pytest.mark.parametrize("n, dims, k, parts", [(90, 6, 7, 1), (90, 6, 7, 5), (2, 5, 9, 2)])
def test_against_plain(spark, n, dims, k, parts):
    prepare(spark)
    rows = vectors(n, dims, dims)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, q string").repartition(parts)
    got = centroid_clustering.cluster(df, k=k, rounds=3, dims=dims).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, k, 3, dims), key=key)


def test_nothing_to_cluster(spark):
    prepare(spark)
    empty = spark.createDataFrame([(1, None), (None, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert centroid_clustering.cluster(empty, dims=2).count() == 0
    assert centroid_clustering.cluster(empty.limit(0), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_screening_leaves_out_distances_but_no_result():
    random_ = np.random.default_rng(1)
    centres = random_.integers(-300, 300, (12, 16)) * np.arange(1, 13)[:, None]
    x = centres[random_.integers(0, 12, 4000)] + random_.integers(-20, 20, (4000, 16))
    far = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    label, best, exact = centroid_clustering.nearest(x, centroid_clustering.segment_norms(x, 4), centres, centroid_clustering.segment_norms(centres, 4))
    assert (label == far.argmin(1)).all() and (best == far.min(1)).all() and exact < 0.25 * far.size


def test_too_large_components_are_an_error(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroid_clustering.cluster(df, dims=2).collect()
