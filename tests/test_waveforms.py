"""Waveforms with gaps: plain versions of peaks, candidates, calibration and bin scores."""

import numpy as np
import pytest

from pulsegrid.functions import kernels
from pulsegrid.operators import waveform
from pulsegrid.operators.lineage import cut, shared

NAN = float("nan")


def plain_peaks(v, height=-np.inf, prominence=0.0, width=0.0, distance=1):
    """By definition, sample by sample, inside one run at a time."""
    out, a = [], 0
    while a < len(v):
        if not np.isfinite(v[a]):
            a += 1
            continue
        b = a
        while b < len(v) and np.isfinite(v[b]):
            b += 1
        tops = []
        for i in range(a + 1, b - 1):
            j = i
            while j + 1 < b and v[j + 1] == v[i]:
                j += 1
            if v[i - 1] < v[i] and j + 1 < b and v[j + 1] < v[i]:
                tops.append((i + j) // 2)
        tops = [p for p in tops if v[p] >= height]
        kept = []
        for p in sorted(tops, key=lambda p: (-v[p], -p)):
            if all(abs(p - q) >= distance for q in kept):
                kept.append(p)
        for p in sorted(kept):
            left = right = p
            while left > a and v[left - 1] <= v[p]:
                left -= 1
            while right < b - 1 and v[right + 1] <= v[p]:
                right += 1
            prom = v[p] - max(v[left : p + 1].min(), v[p : right + 1].min())
            line = v[p] - prom / 2
            i = p
            while v[i] > line:
                i -= 1
            x0 = i + (line - v[i]) / (v[i + 1] - v[i]) if v[i] < line else i
            j = p
            while v[j] > line:
                j += 1
            x1 = j - (line - v[j]) / (v[j - 1] - v[j]) if v[j] < line else j
            if prom >= prominence and x1 - x0 >= width:
                out.append((p, float(prom), float(x1 - x0)))
        a = b
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("gates", [{}, {"height": 0.2, "distance": 5}, {"prominence": 0.8, "width": 1.5, "distance": 3}])
def test_peaks_by_definition(seed, gates):
    random_ = np.random.default_rng(seed)
    v = random_.normal(size=200)
    if seed % 2:
        v = np.round(v, 0)  # flat tops and ties
    v[random_.random(200) < 0.08] = np.nan
    named = {"prominent" if k == "prominence" else k: x for k, x in gates.items()}
    got = [(p["bin"], p["prominence"], p["width"]) for p in kernels.find_peaks(v, **named)]
    want = plain_peaks(v, **gates)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-12)


def test_runs_of_many_waveforms():
    v = np.array([1, NAN, 2, 3, 4, NAN, NAN, 5])
    starts, ends = kernels.finite_runs(v, np.array([0, 3, 3, 5, 8]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 1), (2, 3), (3, 5), (7, 8)]
    assert [len(x) for x in kernels.finite_runs(np.zeros(0))] == [0, 0]


@pytest.fixture(scope="module")
def waves(spark):
    shared(spark, "")
    bridge = [0.0, 1.0, 6.0, None, 9.0, None, 6.0, 1.0, 0.0, 2.0, 12.0, 2.0, 0.0] + [0.0] * 8
    rows = [
        (1, "a", bridge, 0.0, 1.0), (2, "a", [0.0] * 8 + [1.0, 7.0, 9.0, 7.0, 1.0] + [0.0] * 8, 0.0, 1.0), (3, "b", None, 0.0, 1.0), (4, "b", [], 0.0, 1.0), (5, "b", [None] * 21, 0.0, 1.0),
        (6, "b", [0.0, 9.0] + [0.0] * 19, None, 1.0), (7, "b", [0.0, 9.0] + [0.0] * 19, 0.0, 0.0), (8, "b", [0.0] * 21, 0.0, 1.0), (9, "b", [0.0] * 5 + [9.0] + [0.0] * 15, 0.0, 1.0),
    ]
    return spark.createDataFrame(rows, "pulse bigint, rank string, rx array<double>, bg_mean double, bg_std double").withColumn("thres", waveform.F.lit(None).cast("double"))


def test_no_event_bridges_a_gap(waves):
    got = [(r["pulse"], r["rank"], r["bin"], r["excess"]) for r in waveform.events(waves, ["pulse", "rank"], "rx", 5.0, 3.0, 1).orderBy("pulse", "bin").collect()]
    # the lone 9 between two gaps and the 6s at the ends of runs are no peaks; neither is a sample at the end of a waveform
    assert got == [(1, "a", 10, 12.0), (2, "a", 10, 9.0), (9, "b", 5, 9.0)]
    with pytest.raises(ValueError, match="positive"):
        waveform.events(waves, "pulse", "rx", 0.0)


def test_statuses_of_candidates(waves):
    got = {r["pulse"]: (r["status"], r["bin"]) for r in waveform.calibrated(waves, "pulse", "rx", 4.0).collect()}
    assert got == {1: ("invalid_waveform", None), 2: ("candidate", 10), 3: ("invalid_waveform", None), 4: ("invalid_waveform", None), 5: ("invalid_waveform", None), 6: ("invalid_background", None), 7: ("invalid_background", None), 8: ("no_candidate", None), 9: ("no_candidate", None)}


def test_preprocessing_and_components(waves):
    made = {r["pulse"]: r for r in waveform.preprocess(waves, "pulse", "rx", waveform.Preprocess(smoothing="median", window=3)).collect()}
    assert not made[3]["valid"] and not made[5]["valid"] and made[5]["processed"] is None
    assert made[1]["smoothed"][3] is None and made[1]["smoothed"][5] is None and made[1]["sigma"] == 1.0
    with pytest.raises(ValueError, match="background"):
        waveform.Preprocess("other")
    found = waveform.components(waves, "pulse", "rx", waveform.Components(width=0.5, distance=1, edge=6))
    got = {(r["pulse"], r["bin"]): (r["rank"], r["edge"], r["area"]) for r in found.collect()}
    assert got == {(1, 10): (1, False, 16.0), (2, 10): (1, False, 25.0), (9, 5): (1, True, 9.0), (6, 1): (1, True, 9.0), (7, 1): (1, True, 9.0)}
    assert {r["reliability"] for r in waveform.pulse_features(waves.selectExpr("pulse", "1D AS a", "2D AS b", "5D AS snr"), waveform.roles(found, "pulse", waveform.Roles(width=0.5), 6), "pulse", "a", "b", "snr").where("pulse = 8").collect()} == {"no_detected_main_peak"}


def test_curtain_leaves_gaps_out(waves):
    got = {(r["pulse"], r["h"]) for r in waveform.curtain(waves, "pulse", "rx", 20.0, 0.0, 41).collect()}
    assert (1, 20.0) in got and (1, 17.0) not in got and (1, 17.5) not in got and (1, 16.0) in got and (1, 16.5) not in got and (2, 17.0) in got and not [p for p, _ in got if p in (3, 4, 5)]


@pytest.mark.parametrize("parts", [1, 7])
def test_noise_calibration(spark, parts):
    shared(spark, "")
    random_ = np.random.default_rng(5)
    windows = random_.normal(size=(30, 16))
    rows = [(i, w.tolist()) for i, w in enumerate(windows)] + [(100, [None] * 16), (101, [NAN] * 16), (102, [1.0] * 5), (103, None)]
    kept = cut(waveform.noise_windows(spark.createDataFrame(rows, "id bigint, w array<double>"), "id", "w", 16))
    got = waveform.calibrate_noise(kept, 60, 0.95, 3, 200, 150, 2.0, 9, parts).first()
    ids = waveform.block_ids(np.arange(350), 4, 30, 9)
    assert len(np.unique(ids)) == 30 and (ids[:200] != ids[:200][:, :1]).any()
    maxima = []
    for own in ids:
        v = np.concatenate([windows[i] for i in own])[:60]
        maxima.append(max(((p, w) for _, p, w in plain_peaks(v, distance=3)), default=(0.0, 0.0)))
    top, wide = np.array(maxima).T
    threshold = np.quantile(top[:200], 0.95)
    alarms = (top[200:] >= threshold) & (wide[200:] >= 2)
    assert got["n_windows"] == 30 and abs(got["threshold"] - threshold) < 1e-12 and got["false_alarms"] == alarms.sum()
    assert abs(got["false_alarm_rate"] - alarms.mean()) < 1e-12 and abs(got["p95"] - np.quantile(top[200:], 0.95)) < 1e-12
    with pytest.raises(ValueError, match="windows"):
        waveform.calibrate_noise(kept.limit(5), 60)


def test_bin_scores_count_what_is_there(spark):
    shared(spark, "")
    random_ = np.random.default_rng(2)
    n, bins = 40, 6
    z = random_.normal(size=(n, 2, bins)) * 2
    z[random_.random(z.shape) < 0.2] = np.nan
    scene = random_.normal(size=(n, 2))
    scene[::7, 0] = np.nan
    scene[:, 1] = 3.0  # does not vary, so it is not assessed
    rows = [(t, s * 3, [None if x != x else float(x) for x in z[s, t]], 0.0, 1.0, float(scene[s, t])) for s in range(n) for t in range(2)]
    df = spark.createDataFrame(rows, "track bigint, sweep bigint, rx array<double>, bg_mean double, bg_std double, refh double").repartition(3)
    got = {(r["track"], r["bin"]): r for r in waveform.bin_scores(df, "track", "sweep", "rx", 5, 1.0).collect()}
    assert len(got) == 2 * 5
    for (t, b), r in got.items():
        x = z[:, t, b]
        hit = x >= 1.0
        valid = np.isfinite(x).sum()
        run = best = 0
        for h in hit:
            run = run + 1 if h else 0
            best = max(best, run)
        assert (r["n_valid"], r["n_events"], r["longest"]) == (valid, hit.sum(), best)
        assert abs(r["occupancy"] - hit.sum() / valid) < 1e-12 and r["median_sigma"] == sorted(x[hit])[(hit.sum() - 1) // 2]
        if t == 0:
            y = scene[:, 0]
            ok = np.isfinite(y)
            cx = x[ok] - np.nanmean(x[ok])
            cy = y[ok] - y[ok].mean()
            want = np.nansum(cx * cy) / np.sqrt(np.nansum(cx**2) * (cy**2).sum())
            assert r["scene_assessed"] and abs(r["scene_correlation"] - want) < 1e-9
        else:
            assert not r["scene_assessed"] and r["scene_correlation"] is None


def test_fits_are_dealt_over_tasks(spark):
    """A small file of waveforms is one partition, whose fits one task would do."""
    k = np.arange(96)
    rows = [(i, [float(x) for x in 20 * np.exp(-((k - 22 - i) ** 2) / 8) + 0.02 * np.sin(k * 3)]) for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, rx array<double>").coalesce(1)
    found = waveform.gaussians(df, "id", "rx")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["id"]: round(r["centre"], 1) for r in found.collect()} == {i: 22.0 + i for i in range(12)}
