"""Ordered functions by prefix scan against the window form over whole keys, at any number of ranges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ordered


@pytest.fixture(scope="module")
def rows():
    random_ = np.random.default_rng(7)
    n = 600
    key = np.where(random_.random(n) < 0.6, 0, random_.integers(1, 9, n)).astype(object)
    key[::97] = None
    frame = pd.DataFrame({"k": key, "seq": random_.integers(0, 200, n), "id": np.arange(n), "x": random_.normal(size=n).cumsum(), "y": random_.normal(size=n).cumsum(), "v": random_.integers(0, 12, n).astype(float), "w": random_.normal(size=n), "on": random_.random(n) < 0.7})
    frame.loc[::13, "v"] = np.nan
    return frame


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows.astype({"k": "float"}), "k double, seq long, id long, x double, y double, v double, w double, on boolean").select(F.when(~F.isnan("k"), F.col("k").cast("bigint")).alias("k"), "seq", "id", "x", "y", "v", "w", "on")


def groups(rows):
    own = rows.sort_values(["seq", "id"])
    return {None if k != k or k is None else int(k): g for k, g in own.groupby(own.k.astype(float), dropna=False)}


PARTS = pytest.mark.parametrize("parts", [1, 3, 50])


@PARTS
def test_scans(table, rows, parts):
    o = ordered.Ordered(table, ["k"], ["seq", "id"], parts)
    got = o.shifted("was", "w").shifted("will", "w", True).running("sum", "w").running("n", F.lit(1)).result().toPandas().set_index("id")
    for g in groups(rows).values():
        own = got.loc[g.id]
        np.testing.assert_allclose(own["sum"], g.w.cumsum(), atol=1e-9)
        np.testing.assert_allclose(own["was"], g.w.shift().to_numpy(), atol=0)
        np.testing.assert_allclose(own["will"], g.w.shift(-1).to_numpy(), atol=0)
        assert (own["n"].to_numpy() == np.arange(1, len(g) + 1)).all()


@PARTS
def test_paths_jumps_and_headings(table, rows, parts):
    path = ordered.path_length(table, ["k"], ["seq", "id"], parts=parts).toPandas().set_index("id")
    jump = ordered.jumps(table, ["k"], ["seq", "id"], "w", ["x", "y", "w"], parts).toPandas().set_index("id")
    head = ordered.headings(table, ["k"], ["seq", "id"], parts=parts).toPandas().set_index("id")
    for g in groups(rows).values():
        step = np.hypot(g.x.diff(), g.y.diff()).fillna(0)
        np.testing.assert_allclose(path.loc[g.id, "dist"], step.cumsum(), atol=1e-9)
        np.testing.assert_allclose(jump.loc[g.id, "jump"], g.w.diff().abs().to_numpy())
        v = g[["x", "y", "w"]].to_numpy()
        cosine = (v[1:] * v[:-1]).sum(1) / np.linalg.norm(v[1:], axis=1) / np.linalg.norm(v[:-1], axis=1)
        np.testing.assert_allclose(jump.loc[g.id, "turn"].to_numpy()[1:], np.degrees(np.arccos(np.clip(cosine, -1, 1))), atol=1e-6)
        assert math.isnan(jump.loc[g.id, "turn"].to_numpy()[0])
        if len(g) > 1:
            e, n = (np.gradient(g[c].to_numpy()) for c in "xy")  # central differences, one-sided at the ends
            np.testing.assert_allclose(head.loc[g.id, "heading"], np.degrees(np.arctan2(e, n)) % 360, atol=1e-6)


@PARTS
def test_ranks_and_correlation(table, rows, parts):
    low = ordered.ranks(table, ["k"], "v", parts=parts).toPandas().set_index("id")["rank"]
    dense = ordered.ranks(table, ["k"], "v", method="dense", descending=True, parts=parts).toPandas().set_index("id")["rank"]
    rho = {None if k != k else int(k): r for k, r in ordered.spearman(table, ["k"], "v", "w").toPandas().set_index("k")["rho"].items()}
    for k, g in groups(rows).items():
        assert (low[g.id].to_numpy() == g.v.rank(method="min", na_option="bottom").to_numpy()).all()
        assert (dense[g.id].to_numpy() == g.v.rank(method="dense", na_option="bottom", ascending=False).to_numpy()).all()
        both = g.dropna(subset=["v"])
        want = both.v.rank().corr(both.w.rank()) if len(both) >= 5 and both.v.nunique() > 1 else math.nan
        assert (math.isnan(want) and (rho[k] is None or math.isnan(rho[k]))) or abs(rho[k] - want) < 1e-9


@PARTS
def test_segments_and_runs(table, rows, parts):
    got = ordered.segments(table, ["k"], ["seq", "id"], "seq", 3, 2.5, 2, parts=parts).collect()
    runs = {r["k"]: r["longest"] for r in ordered.longest_runs(table, ["k"], ["seq", "id"], "on", parts).collect()}
    want = []
    for k, g in groups(rows).items():
        step = np.hypot(g.x.diff(), g.y.diff()).to_numpy()
        positive = step[np.isfinite(step) & (step > 0)]
        far = 2.5 * max(np.median(positive) if len(positive) else 0.0, 1e-6)
        breaks = (g.seq.diff() > 3).to_numpy() | (step > far)
        for seg, part in g.groupby(np.cumsum(breaks)):
            if len(part) >= 2:
                dx, dy = part.x.iloc[-1] - part.x.iloc[0], part.y.iloc[-1] - part.y.iloc[0]
                want.append((k, seg, len(part), part.seq.iloc[0], part.seq.iloc[-1], bool(dx < 0 or (abs(dx) <= 1e-9 and dy < 0))))
        best = here = 0
        for on in g.on:
            here = here + 1 if on else 0
            best = max(best, here)
        assert runs[k] == best
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["k"], r["seg"], r["n"], r["first"], r["last"], r["reversed"]) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("picks", [1, 2, 5, 10, 1000])
def test_even_pick(table, rows, picks):
    got = {r["id"] for r in ordered.even_pick(table, ["k"], ["seq", "id"], picks, 3).collect()}
    want = set()
    for g in groups(rows).values():
        n = len(g)
        places = range(n) if n <= picks else sorted({math.floor(k * (n - 1) / max(picks - 1, 1)) for k in range(picks)})
        want |= {int(g.id.iloc[i]) for i in places}
    assert got == want


def test_history_shares_and_thirds(table, rows):
    seen = {(r["k"], r["seq"]): (r["seen"], r["steps"]) for r in ordered.history(table, ["k"], "seq", 4).collect()}
    share = ordered.shares(table, ["k"], "w").toPandas().set_index("id")
    third = ordered.thirds(table, ["k"], 0.5).toPandas().set_index("id")
    for k, g in groups(rows).items():
        for s in g.seq:
            assert seen[k, s] == ((g.seq <= s).sum(), g.seq[g.seq <= s].nunique())
        centred = g.w - g.w.mean()
        np.testing.assert_allclose(share.loc[g.id, "centred"], centred, atol=1e-9)
        np.testing.assert_allclose(share.loc[g.id, "share"], centred**2 / (centred**2).sum(), atol=1e-9)
        p = g[["x", "y"]].to_numpy() - g[["x", "y"]].to_numpy().mean(0)
        axis = np.linalg.eigh(p.T @ p)[1][:, 1]
        axis = -axis if axis[0] < 0 else axis
        along = p @ axis
        np.testing.assert_allclose(third.loc[g.id, "along"], along, atol=1e-6)
        a, b = (along.min() + j * (along.max() - along.min()) / 3 for j in (1, 2))
        want = np.where(along < a - 0.25, "calibration", np.where((along > a + 0.25) & (along < b - 0.25), "selection", np.where(along > b + 0.25, "test", "guard")))
        assert (third.loc[g.id, "role"].to_numpy() == want).all()


def test_continuity(table, rows):
    got = {r["k"]: r for r in ordered.continuity(table, ["k"], ["seq", "id"], "v", 4, 3.0).collect()}
    for k, g in groups(rows).items():
        v = g.v.dropna().reset_index(drop=True)
        far = (v - v.rolling(9, center=True, min_periods=1).median()).abs()
        r = got[k]
        if len(v):
            assert abs(r["med"] - far.median()) < 1e-9 and abs(r["p95"] - far.quantile(0.95)) < 1e-9 and r["top"] == far.max() and r["jumps"] == (far >= 3).sum()
        else:
            assert r["med"] is None and r["jumps"] == 0


def test_case_pick(table, rows):
    got = {(r["k"], r["pick"]): r["id"] for r in ordered.case_pick(table, ["k"], "w", "id", "on", 1.0, 0.5, 3.0).collect()}
    want = {}
    for k, g in groups(rows).items():
        size = g.w.abs()
        low = g[size <= 1.0].assign(s=size).sort_values(["s", "id"])
        if len(low):
            want[k, "nearest"] = low.id.iloc[0]
        gross = g[size > 0.5].assign(s=-size).sort_values(["s", "id"])
        if len(gross):
            first = gross.iloc[0]
            want[k, "gross1"] = first.id
            rest = gross.iloc[1:]
            apart = rest[(rest.on != first.on) | (np.hypot(rest.x - first.x, rest.y - first.y) >= 3.0)]
            if len(rest):
                want[k, "gross2"] = (apart if len(apart) else rest).id.iloc[0]
    assert got == want


def test_empty(table):
    none = table.limit(0)
    assert ordered.path_length(none, ["k"], ["seq", "id"]).count() == 0
    assert ordered.ranks(none, [], "v").count() == 0
    assert ordered.segments(none, ["k"], ["seq", "id"], "seq", 3).count() == 0


def test_few_hot_keys_are_not_shuffled_to_a_task_each(spark):
    """A join with a row a key sends that row to the rows, whatever size the planner expects."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60).selectExpr("id", "id % 2 AS k", "cast(id as double) AS x", "cast(id % 7 as double) AS y")
        for out in (ordered.thirds(df, ["k"], 1.0), ordered.shares(df, ["k"], "x"), ordered.even_pick(df, ["k"], ["id"], 4)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("parts", [1, 7])
def test_segments_write_no_column_that_they_do_not_need(spark, parts):
    import os

    rng = np.random.default_rng(9)
    rows = [(None if k % 5 == 0 else k % 3, int(t), k, None if k % 97 == 0 else float(x), float(y), rng.bytes(500).hex()) for k, (t, x, y) in enumerate(zip(np.sort(rng.integers(0, 2500, 2000)), rng.normal(size=2000) * (1 + 30 * (rng.random(2000) < 0.1)), rng.normal(size=2000), strict=True))]
    df = spark.createDataFrame(rows, "track bigint, sweep bigint, id bigint, x double, y double, note string")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(shared) for f in names)
    was = size()
    got = {(r["track"], r["seg"]): (r["n"], r["first"], r["last"], r["length"], r["reversed"]) for r in ordered.segments(df, ["track"], ["sweep", "id"], "sweep", 3, 3.0, 2, parts=parts).collect()}
    assert size() - was < 300_000  # the notes alone are 2 MB
    want = {}
    for track in (None, 0, 1, 2):
        own = sorted(r[1:5] for r in rows if r[0] == track)
        steps = [None, *[None if a[2] is None or b[2] is None else np.hypot(b[2] - a[2], b[3] - a[3]) for a, b in zip(own, own[1:], strict=False)]]
        far = 3 * np.median([s for s in steps if s])
        runs = []
        for i, (r, s) in enumerate(zip(own, steps, strict=True)):
            if not i or r[0] - own[i - 1][0] > 3 or (s is not None and s > far):
                runs.append(([], []))
            elif s is not None:
                runs[-1][1].append(s)
            runs[-1][0].append(r)
        for k, (run, length) in enumerate(runs):
            if len(run) >= 2:
                a, b = run[0], run[-1]
                turned = None if a[2] is None or b[2] is None else bool(b[2] < a[2] or (abs(b[2] - a[2]) <= 1e-9 and b[3] < a[3]))
                want[track, k] = (len(run), a[0], b[0], sum(length), turned)
    assert got.keys() == want.keys() and len(got) > 50
    for k, v in want.items():
        assert got[k][:3] == v[:3] and abs(got[k][3] - v[3]) < 1e-9 and (v[4] is None or got[k][4] == v[4])
