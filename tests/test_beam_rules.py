"""Rule search on data made from a convention, against all rules scored one by one."""

import numpy as np
import pytest

from pulsegrid.operators import beam_rules
from pulsegrid.operators.lineage import shared


def made(rule, seed, noise, n=300):
    random_ = np.random.default_rng(seed)
    az, el = random_.random(n) * 40, 84 + random_.random(n) * 4  # of the convention, in degrees
    if rule.elevation.startswith("angle"):
        el = 90 - el
    first, second, s, t = beam_rules.TRANSFORMS[rule.transform]
    raw = [None, None]
    raw[first], raw[second] = s * az, t * el
    if rule.unit == "radian":
        raw = [np.radians(x) for x in raw]
    u = rule.directions(*raw)
    start = np.array([[5e5], [4.4e6], [8000.0]]) + random_.normal(size=(3, n)) * 0.05
    end = start + u * (7000 + random_.random(n) * 500) + random_.normal(size=(3, n)) * noise
    return raw, start, end


@pytest.mark.parametrize("rule, seed", [(beam_rules.Rule("refh", "east", "counterclockwise", "depression_from_horizon", "as_encoded", "degree", "swap_az_el", 0.02, -0.05), 1), (beam_rules.Rule("instrument", "south", "clockwise", "angle_from_down_vertical", "as_encoded", "radian", "negate_both"), 2)])
def test_the_planted_convention_wins(spark, rule, seed):
    shared(spark, "")
    raw, start, end = made(rule, seed, 0.05)
    rows = [tuple(map(float, x)) for x in np.vstack([*raw, end, start]).T] + [(None, 1.0, *[0.0] * 6), (float("nan"), 1.0, *[0.0] * 6)]
    df = spark.createDataFrame(rows, "a double, b double, x double, y double, z double, ix double, iy double, iz double").repartition(3)
    found = beam_rules.search(df, ("a", "b"), ("x", "y", "z"), ("ix", "iy", "iz")).orderBy("rank").collect()
    best = beam_rules.Rule(*(found[0][f] for f in ("basis", "zero", "rotation", "elevation", "sign", "unit", "transform", "az_bias", "el_bias")))
    assert np.abs(best.directions(*raw) - rule.directions(*raw)).max() < 1e-9  # other names of the same directions are as good
    assert found[0]["passes"] and found[0]["n"] == 300 and found[0]["cross_med"] < 0.2 and len(found) == 8
    # exact medians, by definition
    u, seg = best.directions(*raw), end - start
    cross = np.linalg.norm(np.cross(seg.T, u.T), axis=1)
    assert abs(found[0]["cross_med"] - np.median(cross)) < 1e-6 and abs(found[0]["range_med"] - np.median(np.linalg.norm(seg, axis=0))) < 1e-6
    origin = np.array([found[0][f"origin_{c}"] for c in "xyz"])
    p = end if best.basis == "refh" else start
    away = np.linalg.norm(np.cross((origin[:, None] - p).T, u.T), axis=1)
    assert abs(found[0]["origin_med"] - np.median(away)) < 1e-3 and np.abs(origin - start.mean(1)).max() < 2.0
    # no unbiased rule is better
    for other in beam_rules.all_rules():
        v = other.directions(*raw)
        if np.median((v * seg).sum(0)) > 0:
            assert np.median(np.linalg.norm(np.cross(seg.T, v.T), axis=1)) >= found[0]["cross_med"] - 1e-9


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1.0,) * 8, (2.0,) * 8], "a double, b double, x double, y double, z double, ix double, iy double, iz double")
    assert beam_rules.search(df, ("a", "b"), ("x", "y", "z"), ("ix", "iy", "iz")).count() == 0
    assert beam_rules.rule_count() == len(set(beam_rules.all_rules())) == 1536


def test_sums_of_every_rule_come_from_one_table_of_products(spark):
    random_ = np.random.default_rng(5)
    columns = np.vstack([random_.normal(size=(2, 400)) * 60, random_.normal(size=(6, 400)) * 50])
    df = spark.createDataFrame(columns.T.tolist(), ", ".join(f"v{k} double" for k in range(8))).repartition(3)
    rules = beam_rules.all_rules()[::7] + [beam_rules.replace(r, az_bias=0.3, el_bias=-0.7) for r in beam_rules.all_rules()[::11]]
    found = beam_rules._sums(beam_rules._moments(df), rules)
    a, b, p, i = columns[0], columns[1], columns[2:5], columns[5:8]
    for rule, got in zip(rules, found, strict=True):
        u, seg = rule.directions(a, b), p - i
        along, m = (u * seg).sum(0), np.eye(3) * 400 - u @ u.T
        want = [400, (along / np.linalg.norm(seg, axis=0)).sum(), ((seg * seg).sum(0) - along**2).sum(), *m[np.triu_indices(3)]]
        for q in (p, i):
            t = (u * q).sum(0)
            want += [*(q - u * t).sum(1), ((q * q).sum(0) - t * t).sum()]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("most, sample", [(10_000, 10_000), (3, 200)])
def test_quantiles_of_made_values_are_exact(spark, monkeypatch, most, sample):
    monkeypatch.setattr(beam_rules, "BINS", 16)
    random_ = np.random.default_rng(6)
    v = np.array([random_.normal(size=3000) ** 3, random_.integers(0, 5, 3000), random_.normal(size=3000) * 1e150, np.full(3000, 2.5), np.full(3000, np.nan)])
    v[0, ::50], v[0, 1::50], v[0, 2::70] = np.nan, np.inf, -np.inf
    df = spark.createDataFrame(v.T.tolist(), ", ".join(f"v{k} double" for k in range(5))).repartition(4)
    counts, values = beam_rules._quantiles(df, 3000, lambda columns: iter(columns), range(5), (0.0, 0.5, 0.9, 1.0), most, sample)
    for k in range(5):
        own = v[k][np.isfinite(v[k])]
        assert counts[k] == len(own)
        assert values[k] == ([None] * 4 if not len(own) else pytest.approx(np.quantile(own, (0.0, 0.5, 0.9, 1.0)), rel=1e-12))
