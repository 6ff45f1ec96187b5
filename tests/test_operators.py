"""Vectors and brute force for the DataFrame operators and the kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import geodesy, kernels
from pulsegrid.operators import raster, sampling, spatial
from pulsegrid.sources import readers
from pulsegrid.streaming import windows


@pytest.fixture(scope="module")
def cloud():
    random = np.random.default_rng(3)
    return [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(np.round(random.uniform(0, 20, (150, 3)), 2))]


def test_peaks_vector():
    assert [p["bin"] for p in kernels.find_peaks(np.array([0, 0, 0, 1, 4, 1, 0, 0, 3, 0.0]), 2, 1, 0.3, 2)] == [4, 8]


def test_peaks_plateau_and_edge():
    assert kernels.local_maxima(np.array([0, 2, 2, 2, 0, 1.0])).tolist() == [2]
    assert kernels.local_maxima(np.array([3, 1, 3.0])).tolist() == []


def test_smoothing_keeps_a_cubic():
    v = (np.arange(40.0) / 10) ** 3
    assert np.abs(kernels.smooth(v, 7, 3) - v).max() < 1e-9


def test_gaussians_are_recovered():
    x = np.arange(120.0)
    v = 5 * np.exp(-((x - 34) ** 2) / 18) + 3 * np.exp(-((x - 81) ** 2) / 32) + np.random.default_rng(0).normal(0, 0.05, 120)
    assert [round(c) for _, c, _ in kernels.fit_gaussians(v)] == [34, 81]


def test_knn_against_brute_force(spark, cloud):
    points = spark.createDataFrame(cloud, "id bigint, x double, y double, z double")
    got = {}
    for r in spatial.knn(points, points, 5, 4.0, "id", "id").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["r_id"]))
    for i, x, y, _ in cloud:
        near = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b, _ in cloud)
        want = [j for d, j in near if d <= 4.0][:5]
        assert [j for _, j in sorted(got[i])] == want


def test_idw_takes_a_coincident_value(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "a bigint, x double, y double")
    right = spark.createDataFrame([(1, 0.0, 0.0, 7.0), (2, 1.0, 0.0, 100.0)], "b bigint, x double, y double, z double")
    assert [(r["a"], r["value"]) for r in spatial.idw(left, right, "z", 4, 2.0, 5.0, "a", "b").collect()] == [(1, 7.0)]


def test_plane_is_recovered(spark):
    right = spark.createDataFrame([(i, float(i % 5), float(i // 5), 2 + 0.5 * (i % 5) - 0.25 * (i // 5)) for i in range(25)], "b bigint, x double, y double, z double")
    left = spark.createDataFrame([(1, 2.2, 2.3)], "a bigint, x double, y double")
    got = spatial.plane_fit(left, right, "z", 32, 3.0, "a", "b").first()
    assert got["value"] == pytest.approx(2 + 1.1 - 0.575) and got["rms"] < 1e-6


def test_polygon_overlap_is_ambiguous(spark):
    rois = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (2, [(2.0, 0.0), (6.0, 0.0), (6.0, 4.0), (2.0, 4.0)])], "roi_id bigint, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 9.0, 9.0)], "id bigint, x double, y double")
    assert sorted(map(tuple, spatial.in_polygon(points, rois, "id").collect())) == [(1, 1, False), (2, None, True)]


def test_holes_are_filled(spark):
    ring = [(a, b) for a in range(5) for b in range(5) if not (1 <= a <= 3 and 1 <= b <= 3)]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert raster.without_holes(spark.createDataFrame(ring, "ix bigint, iy bigint")).count() == 25


def test_closing_fills_a_gap(spark):
    cells = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if (a, b) != (2, 2)], "ix bigint, iy bigint")
    assert (2, 2) in {tuple(r) for r in raster.closed(cells, 1).collect()}


def test_utm_and_ecef_round_trips(spark):
    df = spark.createDataFrame([(-86.9, 40.4, 250.0), (151.0, -33.0, 12.0), (0.5, 51.0, 0.0)], "lon double, lat double, h double")
    df = df.withColumn("epsg", geodesy.utm_epsg(F.col("lon"), F.col("lat")))
    e, n = geodesy.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    df = df.withColumn("e", e).withColumn("n", n)
    lon, lat = geodesy.from_utm(F.col("e"), F.col("n"), F.col("epsg"))
    x, y, z = geodesy.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    df = df.withColumn("x", x).withColumn("y", y).withColumn("z", z)
    lon2, lat2, h2 = geodesy.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    for r in df.select("*", lon.alias("lon1"), lat.alias("lat1"), lon2.alias("lon2"), lat2.alias("lat2"), h2.alias("h2")).collect():
        assert r["lon1"] == pytest.approx(r["lon"], abs=1e-9) and r["lat1"] == pytest.approx(r["lat"], abs=1e-9)
        assert r["lon2"] == pytest.approx(r["lon"], abs=1e-9) and r["lat2"] == pytest.approx(r["lat"], abs=1e-8) and r["h2"] == pytest.approx(r["h"], abs=1e-3)
    assert [r["epsg"] for r in df.select("epsg").collect()] == [32616, 32756, 32631]


def test_geodesic_along_the_equator(spark):
    d = spark.range(1).select(geodesy.geodesic(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d")).first()["d"]
    assert d == pytest.approx(6378137.0 * math.pi / 180, abs=1e-3)


def test_geodesic_evaluates_no_nested_loop_a_row(spark):
    """Rounds cost vector operations over batches; a plan with a lambda holds each round's terms many times over."""
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (10.0, 50.0, 10.0, 50.0), (-5.0, -3.0, 141.0, 60.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    out = df.select(geodesy.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    m = [r["m"] for r in out.collect()]
    assert m[0] == pytest.approx(110574.3886, abs=1e-3) and m[1] == 0 and m[3] is None  # a degree of the meridian at the equator
    assert m[2] == pytest.approx(13_050_000, rel=0.01)


def test_samples_ignore_partitioning(spark):
    a, b = spark.range(1000).repartition(3), spark.range(1000).repartition(7)
    assert {r[0] for r in sampling.sample(a, "id", 50).collect()} == {r[0] for r in sampling.sample(b, "id", 50).collect()}


def test_readers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0)], "z double, amp double")
    assert readers.nulled(df).where("z IS NULL").count() == 1
    assert readers.resolve(df, {"refh": ("refh", "z")}).columns == ["refh", "amp"]
    with pytest.raises(ValueError):
        readers.resolve(df, {"lon": ("lon",)})
    with pytest.raises(ValueError):
        readers.checked(spark.createDataFrame([(1,), (1,)], "k bigint"), ["k"])
    assert readers.json_safe({"a": float("nan"), "b": np.int64(3)}) == {"a": None, "b": 3}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 10:02d}:{i % 60:02d}:00", i % 3, "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = windows.run_to_end(windows.latest(stream).select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {tuple(r) for r in got.collect()} == {(r[0], r[4]) for r in rows}
