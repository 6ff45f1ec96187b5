"""Labelling of noise sends its few full cells to the points, and gives the same rows where they are too many for that."""

import numpy as np
import pytest

from pulsegrid.operators import noise, statistics


@pytest.fixture()
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(z), float(s), float(a), 0.5) for i, (x, y, z, s, a) in enumerate(zip(*rng.uniform(0, 9, (3, 400)), *rng.uniform(0, 4, (2, 400)), strict=True))]
    rows += [(400, None, 1.0, 50.0, 3.0, 3.0, 0.5), (401, 1.0, 1.0, float("nan"), 3.0, 3.0, 0.5), (402, 900.0, 1.0, 1.0, 3.0, None, 0.5)]
    return spark.createDataFrame(rows, "pulse_index bigint, x double, y double, refh double, snr double, amp double, thres double")


OPTIONS = noise.NoiseOptions(cell=3.0, residual=2.0, mad_multiple=1.0, least_sigma=0.1, height_shares=(0.02, 0.98))


def test_points_are_not_shuffled(spark, points):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = noise.label_noise(points, OPTIONS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_full_cells_give_the_same(points, monkeypatch):
    few = noise.label_noise(points, OPTIONS).collect()
    monkeypatch.setattr(statistics, "BROADCAST_ROWS", 0)
    many = noise.label_noise(points, OPTIONS).collect()
    key = lambda r: r["pulse_index"]
    assert list(map(repr, sorted(few, key=key))) == list(map(repr, sorted(many, key=key)))
    by = {r["pulse_index"]: r for r in few}
    assert len(few) == 403 and by[400]["local_median"] is None and by[402]["local_median"] is None and by[401]["local_median"] is not None
    bits = {k for r in few for k in (2, 8, 32) if r["reason"] & k}
    low, high = np.quantile([r["refh"] for r in few if r["refh"] == r["refh"]], (0.02, 0.98))
    assert bits == {2, 8, 32} and all(bool(r["reason"] & 32) == (r["refh"] < low or r["refh"] > high) for r in few)
