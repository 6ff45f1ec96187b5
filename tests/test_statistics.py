"""Robust statistics, noise reasons, the cascade, alignment and streams with parameters, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import crs, kernels
from pulsegrid.operators import alignment, classify, noise, statistics, waveform
from pulsegrid.streaming import windows


@pytest.mark.parametrize("most", [10_000, 20])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(1)
    ps = [0.0, 0.001, 0.05, 0.5, 0.68, 0.95, 0.999, 1.0]
    for values in (rng.normal(size=3001), np.exp(rng.normal(size=2000) * 9), np.repeat([1.0, 2.0, 2.0, 7.5], 300), np.array([3.0]), np.array([3.0, 4.0])):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),), (float("inf"),)], "v double").repartition(3)
        got = statistics.quantile_values(df, "v", ps, most=most, bins=16)
        assert np.allclose(got, np.quantile(values, ps), rtol=1e-12)
    assert statistics.quantile_values(df.limit(0), "v", ps) == [None] * len(ps)


def test_metrics_and_clipping(spark):
    rng = np.random.default_rng(2)
    r = np.concatenate([rng.normal(size=500), [40.0, -50.0]])
    df = spark.createDataFrame([(float(x),) for x in r] + [(None,)], "r double")
    m = statistics.distribution_metrics(df, "r").first()
    assert m["n"] == 502 and np.isclose(m["med"], np.median(r)) and np.isclose(m["nmad"], 1.4826 * np.median(np.abs(r - np.median(r)))) and np.isclose(m["a68"], np.quantile(np.abs(r), 0.68)) and np.isclose(m["rmse"], np.sqrt((r**2).mean()))
    assert statistics.distribution_metrics(df.limit(0), "r").first()["med"] is None
    c = statistics.clipped_median(df, "r").first()
    assert c["n"] < 502 and abs(c["med"]) < 0.2
    with pytest.raises(ValueError):
        statistics.cells(df.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)), 0.0)


def test_every_noise_reason(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.uniform(0, 20)), float(rng.uniform(0, 20)), float(rng.normal(50, 0.3)), 5.0, 10.0, 1.0, 0.0, 0.0) for i in range(400)]
    odd = {"low_snr_hard": (900, 3.0, 3.0, 50.0, 1.0, 10.0, 1.0, 0.0, 0.0), "low_snr_and_low_amp": (901, 3.0, 3.0, 50.0, 1.7, 2.0, 1.0, 0.0, 0.0), "below_refh_threshold": (902, 3.0, 3.0, 50.0, 5.0, 10.0, 11.0, 0.0, 0.0), "local_height_outlier": (903, 3.0, 3.0, 90.0, 5.0, 10.0, 1.0, 0.0, 0.0), "open3d_sor_outlier": (904, 300.0, 300.0, 50.0, 5.0, 10.0, 1.0, 0.0, 0.0), "refh_error_exceeds_threshold": (905, 3.0, 3.0, 50.0, 5.0, 10.0, 1.0, 9.0, 0.0), "refh_horizontal_error_exceeds_threshold": (906, 3.0, 3.0, 50.0, 5.0, 10.0, 1.0, 0.0, -9.0)}
    df = spark.createDataFrame(rows + list(odd.values()) + [(999, None, None, None, None, None, None, None, None)], "pulse_index bigint, x double, y double, refh double, snr double, amp double, thres double, refh_error double, refh_latitude_error double")
    got = {r["pulse_index"]: r for r in noise.label_noise(df, noise.NoiseOptions(error=1.0, horizontal_error=1.0, height_shares=(0.0, 0.999), neighbours=8)).collect()}
    for name, row in odd.items():
        assert got[row[0]]["reason"] & noise.REASONS[name] and not got[row[0]]["keep"]
    assert got[903]["reason"] & noise.REASONS["global_z_percentile_guard"] and got[999]["keep"] and got[999]["reason"] == 0
    assert sum(not got[i]["keep"] for i in range(400)) < 40
    hits = {r["name"]: r["hits"] for r in noise.reason_counts(noise.label_noise(df)).collect()}
    assert set(hits) == set(noise.REASONS) and hits["low_snr_hard"] == 1 and hits["open3d_sor_outlier"] == 0


def test_cascade_reasons(spark):
    o = classify.CascadeOptions(near_ground_guard=True, support_confidence=True, signal_density_noise=True, shallow=0.5, below=1.5, scanline_group=5)
    points = {
        "ground_abs_hag_within_tol": (10.0, 10.0, 9.0, 5.0, 1.0), "unclassified_missing_dtm": (10.0, None, 9.0, 5.0, 1.0), "noise_nonfinite_height": (float("nan"), 10.0, 9.0, 5.0, 1.0), "noise_below_ground": (5.0, 10.0, 9.0, 5.0, 1.0),
        "noise_above_max_hag": (60.0, 10.0, 9.0, 5.0, 1.0), "noise_low_density_processed_only": (15.0, 10.0, 9.0, 0.001, 1.0), "processed_unclassified_valid_hag": (15.0, 10.0, 9.0, 5.0, 1.0), "ground_rejected_low_signal_to_processed": (10.0, 10.0, 1.0, 5.0, 1.0),
        "ground_rejected_weak_dtm_to_processed": (10.0, 10.0, 9.0, 5.0, 99.0), "ground_rejected_low_density_to_processed": (10.0, 10.0, 9.0, 0.015, 1.0),
    }
    df = spark.createDataFrame([(name, *p) for name, p in points.items()], "want string, refh double, ground double, snr double, density double, support_dist double")
    for r in classify.classify(df, o).collect():
        assert r["reason"] == classify.REASONS[r["want"]], r
    loose = classify.CascadeOptions(least_density=None, signal_density_noise=True)
    assert classify.classify(df.where("want = 'noise_low_density_processed_only'").withColumn("snr", F.lit(1.0)), loose).first()["reason"] == 13
    shallow = spark.createDataFrame([(8.0, 10.0, 9.0, 5.0, 1.0), (8.0, 10.0, 9.0, 5.0, 99.0)], "refh double, ground double, snr double, density double, support_dist double")
    assert [r["reason"] for r in classify.classify(shallow, classify.CascadeOptions(shallow=3.0)).orderBy("support_dist").collect()] == [16, 17]
    lines = spark.createDataFrame([(10.0 + 0.01 * k, 10.0, 5.0, 1) for k in range(30)] + [(20.0, 10.0, 5.0, 1)], "refh double, ground double, density double, track_num int")
    found = classify.classify(lines, classify.CascadeOptions(scanline_z=(5.0, None), scanline_group=5)).where("reason = 15").collect()
    assert [r["refh"] for r in found] == [20.0]
    with pytest.raises(ValueError):
        classify.CascadeOptions(mode="other")


def test_ground_falls_back_to_the_cells_around(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 9.0), (2, 2.0, 2.0, 7.0, 9.0), (3, 20.0, 1.0, 9.0, 1.0), (4, 500.0, 1.0, 9.0, 1.0)], "pulse_index bigint, x double, y double, refh double, snr double")
    grid = classify.ground_grid(points, 15.0, 0.0, 5.0)
    got = {r["pulse_index"]: r["ground"] for r in classify.sample_ground(points, grid).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 5.0, 4: None}


def test_alignment_raises(spark):
    schema = "pulse_index bigint, lon double, refh double, class int, withheld boolean"
    prediction = spark.createDataFrame([(1, 0.5, 3.0), (2, 0.6, None), (3, 0.7, 5.0)], "pulse_index bigint, lon double, refh double")
    good = [(1, 0.5, 3.0, 2, False), (2, 0.6, None, 7, False), (3, 0.7, 5.0, 2, True)]
    limits = {"lon": 1e-7, "refh": 1e-3}
    out = alignment.align(prediction, spark.createDataFrame(good, schema), "pulse_index", limits, "class", "withheld").collect()
    assert sorted(tuple(r) for r in out) == [(1, True, 2), (2, False, 7), (3, False, 2)]
    for bad in (good + [good[0]], good + [(9, 0.5, 3.0, 2, False)], [(1, 0.5001, 3.0, 2, False)], [(2, 0.6, 1.0, 2, False)], [(None, 0.5, 3.0, 2, False)]):
        with pytest.raises(ValueError):
            alignment.align(prediction, spark.createDataFrame(bad, schema), "pulse_index", limits, "class")
    with pytest.raises(ValueError):
        alignment.align(prediction, spark.createDataFrame(good, schema).drop("lon"), "pulse_index", limits, "class")


def test_late_rows_are_counted(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    for k, rows in enumerate([[(1, "2024-01-01 10:00:00"), (2, "2024-01-01 20:00:00")], [(3, "2024-01-01 10:30:00"), (4, "2024-01-01 20:30:00")]]):
        frame = spark.createDataFrame([(i, t) for i, t in rows], "event_id bigint, ts string").selectExpr("event_id", "cast(ts as timestamp) AS ts", "1L AS user_id", "'a' AS event_type", "1.0D AS value")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = windows.run(windows.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert windows.dropped(query) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_horizontal_reference_systems(spark):
    wkt = 'COMPD_CS["a",PROJCS["WGS 84 / UTM zone 16N",GEOGCS["WGS 84",AUTHORITY["x","EPSG:4326"]],AUTHORITY["x","EPSG:32616"]],VERT_CS["NAVD88",AUTHORITY["x","EPSG:5703"]]]'
    rows = [("EPSG:32616+5703", 32616), ("epsg 4326", 4326), ("WGS 84 / UTM zone 16N", 32616), ("utm 7s", 32707), ("UTM zone 99", None), ("nothing", None), (None, None), (wkt, 32616)]
    got = spark.createDataFrame(rows, "t string, want int").select(crs.horizontal(F.col("t")).alias("c"), "want").collect()
    assert [r["c"] for r in got] == [r["want"] for r in got]
    with pytest.raises(Exception, match="no horizontal part"):
        spark.createDataFrame([('VERT_CS["NAVD88"]',)], "t string").select(crs.horizontal(F.col("t"))).collect()


def test_mixtures_of_known_components(spark):
    x, rng = np.arange(120.0), np.random.default_rng(1)
    bump = lambda a, c, s: a * np.exp(-((x - c) ** 2) / (2 * s**2))
    waves = [bump(8, 30, 3) + bump(5, 70, 4), bump(6, 50, 5), 0 * x]
    rows = [(k, [float(v) for v in w + rng.normal(0, 0.15, 120)]) for k, w in enumerate(waves)] + [(9, None)]
    found = waveform.gaussians(spark.createDataFrame(rows, "pulse_index bigint, rx array<double>"), "pulse_index", "rx").orderBy("pulse_index", "rank").collect()
    got = [(r["pulse_index"], round(r["centre"]), round(r["amplitude"]), round(r["sigma"])) for r in found]
    assert got == [(0, 30, 8, 3), (0, 70, 5, 4), (1, 50, 6, 5)]
    high = np.tile([np.inf, 119, 30], 2)
    assert not kernels.admissible(np.array([5.0, 50, 4, 5, 52, 4]), 0.1, np.tile([0, 0, 0.5], 2), high)


@pytest.mark.parametrize("most", [10_000, 20, 3])
def test_rows_meet_the_median_of_their_group_in_one_shuffle(spark, most):
    from pulsegrid.operators import quantiles

    rng = np.random.default_rng(3)
    rows = [(k, None if k % 31 == 0 else 0 if k % 3 == 0 else int(rng.integers(1, 60)), None if k % 17 == 0 else float("nan") if k % 19 == 0 else float(rng.normal())) for k in range(600)]
    df = spark.createDataFrame(rows, "id bigint, g bigint, v double")
    out = quantiles.with_median_nmad(df, "g", "v", 1e-6, most=most)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.count("Join") == (most < 10_000)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["id", "g", "v", "_med", "_n", "_nmad"]
    for k, g, _ in rows:
        own = [v for _, h, v in rows if h == g and v is not None and np.isfinite(v)]
        r = got[k]
        if g is None:
            assert r["_n"] is r["_med"] is r["_nmad"] is None
            continue
        assert r["_n"] == len(own)
        if own:
            med = np.median(own)
            assert abs(r["_med"] - med) < 1e-12 and abs(r["_nmad"] - max(1e-6, 1.4826 * np.median(np.abs(np.array(own) - med)))) < 1e-12
        else:
            assert r["_med"] is None and r["_nmad"] is None
    z = statistics.group_robust_z(df, "v", "g", "z", 4)
    assert z._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0 and z.columns == ["id", "g", "v", "z"]


def test_ground_of_own_cell_without_a_join(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, rng.uniform(-20, 20, 2)), None if k % 13 == 0 else float(rng.normal()), float(k % 9)) for k in range(400)] + [(400, None, 1.0, 1.0, 9.0)]
    points = spark.createDataFrame(rows, "id bigint, x double, y double, refh double, snr double")
    out = classify.with_cell_ground(points, 5.0, 0.1, 7.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    grid = {(r["ix"], r["iy"]): (r["z"], r["n"]) for r in classify.ground_grid(points, 5.0, 0.1, 7.0).collect()}
    got = {r["id"]: (r["ix"], r["iy"], r["ground"], r["n"]) for r in out.collect()}
    assert len(got) == 401 and got[400][2:] == (None, None) and any(z is None for _, _, z, _ in got.values())
    assert all((z, n) == grid.get((i, j), (None, None)) for i, j, z, n in got.values())
