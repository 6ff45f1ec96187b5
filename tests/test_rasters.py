"""Holes, openings, ground and polygons against plain versions on dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import classify, graph, raster, sampling, spatial


def flood(mask):
    """Cells and enclosed background of a padded mask, by plain flooding over sides."""
    padded = np.pad(mask, 1)
    out, waiting = np.zeros_like(padded), [(0, 0)]
    while waiting:
        i, j = waiting.pop()
        if 0 <= i < padded.shape[0] and 0 <= j < padded.shape[1] and not padded[i, j] and not out[i, j]:
            out[i, j] = True
            waiting += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return ~out[1:-1, 1:-1]


def spiral(n):
    mask = np.zeros((n, n), bool)
    i = j = 0
    di, dj = 0, 1
    for _ in range(n * n):
        mask[i, j] = True
        a, b = i + 2 * di, j + 2 * dj
        if not (0 <= i + di < n and 0 <= j + dj < n) or 0 <= a < n and 0 <= b < n and mask[a, b]:
            di, dj = dj, -di
            if mask[(i + di) % n, (j + dj) % n]:
                break
        i, j = i + di, j + dj
        if not (0 <= i < n and 0 <= j < n):
            break
    return mask


@pytest.mark.parametrize("shape", ["random", "dense", "spiral", "ring", "empty"])
def test_holes(spark, shape, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(4)
    mask = {"random": rng.random((40, 50)) < 0.55, "dense": rng.random((30, 30)) < 0.75, "spiral": spiral(17), "ring": np.pad(np.zeros((5, 5), bool), 1, constant_values=True), "empty": np.zeros((3, 3), bool)}[shape]
    cells = spark.createDataFrame([(int(j) - 7, int(i) - 3) for i, j in np.argwhere(mask)], "ix bigint, iy bigint")
    got = {(r["ix"] + 7, r["iy"] + 3) for r in raster.without_holes(cells).collect()}
    assert got == {(int(j), int(i)) for i, j in np.argwhere(flood(mask))}


def test_components_of_a_long_path(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pairs = [(k, k + 1) for k in range(100)] + [(1000, 1000), (2000, 2001), (None, 4)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(101)}, 2000: 2000, 2001: 2000}


def test_progressive_opening_and_smoothing(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(5)
    z = rng.normal(size=(14, 17)) + 10
    z[4:7, 5:8] += 9
    cells = spark.createDataFrame([(j, i, float(z[i, j])) for i in range(14) for j in range(17)], "ix bigint, iy bigint, z double")

    def slide(a, n, f):
        p = np.pad(a, n // 2, mode="edge")
        return np.array([[f(p[i : i + n, j : j + n]) for j in range(a.shape[1])] for i in range(a.shape[0])])

    want = z.copy()
    for n, t in raster.windows_of([3.0, 5.0], 1.0, 0.5, 0.2, 1.2):
        low = slide(want, n, np.min)
        top = slide(low, n, np.max)
        want = np.where(want - top > t, top, want)
    got = {(r["ix"], r["iy"]): r["z"] for r in raster.progressive(cells, raster.windows_of([3.0, 5.0], 1.0, 0.5, 0.2, 1.2)).collect()}
    assert np.allclose([[got[j, i] for j in range(17)] for i in range(14)], want)
    assert raster.windows_of([3.0, 8.0, 100.0], 2.0, 0.5, 0.1, 4.0) == [(3, 0.8), (5, 1.3), (51, 4.0)]
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    w = np.outer(k, k)
    smooth = {(r["ix"], r["iy"]): r["z"] for r in raster.smoothed(cells, 1.0).collect()}
    for i, j in ((0, 0), (7, 8), (13, 3)):
        num = den = 0.0
        for a in range(-4, 5):
            for b in range(-4, 5):
                if 0 <= i + a < 14 and 0 <= j + b < 17:
                    num, den = num + w[a + 4, b + 4] * z[i + a, j + b], den + w[a + 4, b + 4]
        assert np.isclose(smooth[j, i], num / den)


def test_ground_lies_under_a_roof(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(6)
    rows = [(k, float(x), float(y), float(50 + 0.01 * x + (8.0 if 40 < x < 52 and 40 < y < 52 else 0.0) + rng.normal(0, 0.05))) for k, (x, y) in enumerate(rng.uniform(0, 100, (6000, 2)))]
    points = spark.createDataFrame(rows, "pulse_index bigint, x double, y double, refh double").where(~((F.col("x").between(60, 72)) & (F.col("y").between(60, 72))))
    base = {(r["ix"], r["iy"]): (r["n"], r["z"]) for r in raster.ground(points).collect()}
    assert abs(base[11, 11][1] - 50.5) < 0.6 and base[16, 16][0] == 0 and abs(base[16, 16][1] - 50.6) < 0.6
    kinds = {r["pulse_index"]: r["class"] for r in raster.classified(points).collect()}
    roof = [k for k, x, y, _ in rows if 43 < x < 49 and 43 < y < 49]
    assert {kinds[k] for k in roof} == {1} and sum(kinds[k] == 2 for k, x, _, _ in rows if x < 36) > 0.95 * sum(x < 36 for _, x, _, _ in rows)


def test_polygons_and_strata(spark):
    rng = np.random.default_rng(7)
    xy = rng.uniform(-60, 60, (500, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "pid bigint, x double, y double")
    rings = spark.createDataFrame([(1, [(-50.0, -50.0), (50.0, -50.0), (0.0, 55.0)]), (2, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "roi_id bigint, ring array<struct<x:double,y:double>>")
    got = {r["pid"]: (r["roi_id"], r["ambiguous"]) for r in spatial.in_polygon(points, rings, "pid").collect()}
    for k, (x, y) in enumerate(xy):
        one = -50 < y and (y + 50) / 105 < min((x + 50) / 50, (50 - x) / 50)
        two = 0 < x < 10 and 0 < y < 10
        assert got.get(k) == ((None, True) if one and two else (1, False) if one else (2, False) if two else None)
    chosen = sampling.stratified(points, F.floor(F.col("x") / 60), "pid", 80, 2, shards=4)
    again = sampling.stratified(points.repartition(7), F.floor(F.col("x") / 60), "pid", 80, 2, shards=9)
    assert chosen.count() == 80 and {r["pid"] for r in chosen.collect()} == {r["pid"] for r in again.collect()}
    assert min(r["count"] for r in chosen.groupBy(F.floor(F.col("x") / 60)).count().collect()) >= 20


@pytest.mark.parametrize(("cell", "radius", "k"), [(4.0, 30.0, 12), (1.0, 3.0, 1)])
def test_filling_equals_plain_search_and_makes_no_row_a_pair(spark, cell, radius, k, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 8)
    rng = np.random.default_rng(5)
    known = {(int(x), int(y)): float(z) for x, y, z in zip(*rng.integers(-30, 30, (2, 300)), rng.normal(size=300), strict=True)}
    wanted = {(int(x), int(y)) for x, y in rng.integers(-45, 45, (400, 2))}
    near = {}
    for x, y in wanted - set(known):
        found = sorted(((x - a) ** 2 + (y - b) ** 2, a, b) for a, b in known if ((x - a) ** 2 + (y - b) ** 2) * cell**2 <= radius**2)[:k]
        if found:
            near[x, y] = [(cell * d**0.5, known[a, b]) for d, a, b in found]
    have = spark.createDataFrame([(*p, z) for p, z in known.items()], "ix bigint, iy bigint, z double")
    asked = spark.createDataFrame(sorted(wanted), "ix bigint, iy bigint")
    first = raster.filled_nearest(have, asked, cell, radius)
    assert "Generate" not in first._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
    got = {(r["ix"], r["iy"]): (r["z"], r["dist"]) for r in first.collect()}
    assert got == {**{p: (known[p], 0.0) for p in wanted & set(known)}, **{p: (v[0][1], v[0][0]) for p, v in near.items()}}
    blend = {(r["ix"], r["iy"]): r["z"] for r in raster.filled_idw(have, asked, cell, k, 2.0, radius).collect() if r["source"] == 2}
    assert blend.keys() == near.keys() and all(abs(blend[p] - sum(z / d**2 for d, z in v) / sum(1 / d**2 for d, _ in v)) < 1e-12 for p, v in near.items())


def scattered(spark, seed=8, n=1500):
    """Points over 60 x 60 with a ring around an empty place."""
    xy = np.random.default_rng(seed).uniform(-30, 30, (n, 2))
    far = np.hypot(*(xy - 8).T)
    return spark.createDataFrame([(k, float(x), float(y), float(40 + 0.1 * x + (k % 7 == 0) * 6)) for k, (x, y) in enumerate(xy[(far > 9) & ((far < 16) | (xy[:, 0] < 0))])], "pulse_index bigint, x double, y double, refh double")


def planned(df, what):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count(what)


def test_ground_joins_no_rasters(spark, monkeypatch):
    points = scattered(spark)
    found = []
    for width in (16, 1000):
        monkeypatch.setattr(raster, "_width", lambda halo, w=width: w)
        out = raster.ground(points, 1.0, radius=5.0, sigma=0.5, sizes=(3.0, 5.0))
        assert planned(out, "Join") == 0  # a raster of few bytes would go through the driver
        found.append({(r["ix"], r["iy"]): (r["n"], r["z"]) for r in out.collect()})
    assert found[0] == found[1] and any(n == 0 for n, _ in found[0].values())
    # the hole within the ring is filled as far as the radius, and nothing outside
    assert (8, 0) in found[0] and (8, 8) not in found[0] and (25, 25) not in found[0]


def test_points_meet_their_ground_once_and_not_by_broadcast(spark, monkeypatch):
    points = scattered(spark)
    want = sorted(map(tuple, raster.classified(points).collect()))
    monkeypatch.setattr(classify, "BROADCAST_ROWS", 3)
    out = raster.classified(points)
    assert planned(out, "SortMergeJoin") == 1 and planned(out, "Broadcast") == 0
    assert sorted(map(tuple, out.collect())) == want and len(want) == points.count()
    # few cells have ground: the others' points take it from around, or have none
    some = spark.createDataFrame([(0, 0, 41.0), (3, 0, 47.0), (4, 0, 50.0), (60, 60, 1.0), (61, 60, 1.0)], "ix bigint, iy bigint, z double")
    got = {r["pulse_index"]: r["ground"] for r in classify.sample_ground(points, some, 4.0, 12, 2.0, 9.0).collect()}
    for r in points.collect():
        near = sorted((np.hypot((i + 0.5) * 4 - r["x"], 2 - r["y"]), z) for i, z in ((0, 41.0), (3, 47.0), (4, 50.0)))
        near = [(d, z) for d, z in near if d <= 9]
        own = {0: 41.0, 3: 47.0, 4: 50.0}.get(r["x"] // 4) if 0 <= r["y"] < 4 else None
        blend = sum(z / d**2 for d, z in near) / sum(1 / d**2 for d, _ in near) if near else None
        assert got[r["pulse_index"]] == own if own else (got[r["pulse_index"]] is None) == (blend is None) and (blend is None or abs(got[r["pulse_index"]] - blend) < 1e-9)


def test_surface_shuffles_points_and_cells_once(spark, monkeypatch):
    points = scattered(spark)
    known = raster.grid(points, "refh", 2.0, 0.95).select("ix", "iy", "z")
    want = {tuple(r) for r in raster.filled_idw(known, raster.closed(known, 2), 2.0, 12, 2.0, 8.0).collect()}
    for width in (8, 100):
        monkeypatch.setattr(raster, "_width", lambda halo, w=width: w)
        out = raster.surface(points)
        assert planned(out, "Exchange hash") == 2
        got = {tuple(r) for r in out.collect()}
        assert {(a, b, s) for a, b, _, s in got} == {(a, b, s) for a, b, _, s in want} and {s for *_, s in got} == {1, 2}
        assert np.allclose([r[2] for r in sorted(got)], [r[2] for r in sorted(want)], atol=1e-9)


def test_smoothing_shuffles_cells_once(spark, monkeypatch):
    cells = raster.grid(scattered(spark), "refh", 1.0, 0.5).select("ix", "iy", "z").checkpoint()
    z = {(r["ix"], r["iy"]): r["z"] for r in cells.collect()}
    k = np.exp(-0.5 * (np.arange(-3, 4) / 1.5) ** 2)
    for width in (5, 1000):
        monkeypatch.setattr(raster, "_width", lambda halo, w=width: w)
        out = raster.smoothed(cells, 1.5, 2.0)
        assert planned(out, "Exchange") == 1 and planned(out, "Aggregate") == 0
        got = {(r["ix"], r["iy"]): r["z"] for r in out.collect()}
        assert got.keys() == z.keys()
        for x, y in z:
            near = [(k[a + 3] * k[b + 3], z[x + a, y + b]) for a in range(-3, 4) for b in range(-3, 4) if (x + a, y + b) in z]
            assert abs(got[x, y] - sum(w * v for w, v in near) / sum(w for w, _ in near)) < 1e-9
