"""Parameter sweep against plain loops; shared tables are built once and a broken run goes on where it stopped."""

import json
import os

import numpy as np
import pytest

from pulsegrid.operators import classify, sweep
from pulsegrid.operators.lineage import shared

GRID = [sweep.Setting(mode, share=share, tolerance=tol, radius=r, least_density=0.004 if r else None, reach=12.0, cell=6.0) for mode, r in (("height_only", None), ("height_density_post_ground", 4.0)) for share in (0.02, 0.5) for tol in (0.5, 1.5)]


@pytest.fixture(scope="module")
def points(spark):
    shared(spark, "")
    random_ = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], float(x), float(y), float(z) if i % 19 else None, float(s), int(c)) for i, (x, y, z, s, c) in enumerate(zip(random_.random(240) * 20, random_.random(240) * 20, random_.random(240) * 6, random_.random(240) * 12, random_.choice([1, 2, 7], 240), strict=True))]
    return rows, spark.createDataFrame(rows, "pulse_index bigint, granule string, x double, y double, refh double, snr double, ref_class int")


def plain(rows, s):
    out = {}
    for file in "ab":
        own = [r for r in rows if r[1] == file]
        grid = {}
        for _, _, x, y, z, snr, _ in own:
            if snr >= s.snr and z is not None:
                grid.setdefault((int(x // s.cell), int(y // s.cell)), []).append(z)
        grid = {k: np.quantile(v, s.share) for k, v in grid.items() if len(v) >= s.least}
        counts = dict.fromkeys(sweep.COUNTS, 0)
        for _, _, x, y, z, _, truth in own:
            cell = (int(x // s.cell), int(y // s.cell))
            ground = grid.get(cell)
            if ground is None:
                near = sorted((np.hypot((i + 0.5) * s.cell - x, (j + 0.5) * s.cell - y), (i, j), v) for (i, j), v in grid.items())
                near = [n for n in near if n[0] <= s.reach][: s.neighbours]
                if near:
                    w = [1 / n[0] ** s.power for n in near]
                    ground = sum(a * n[2] for a, n in zip(w, near, strict=True)) / sum(w)
            hag = None if z is None or ground is None else z - ground
            dense = None
            if s.radius and z is not None:
                dense = sum((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 <= s.radius**2 for _, _, a, b, c, _, _ in own if c is not None) / (4 / 3 * np.pi * s.radius**3)
            if ground is None:
                kind = 1
            elif hag is None:
                kind = 7
            elif abs(hag) <= s.tolerance:
                kind = 2
            elif (s.mode == "height_density_post_ground" and dense is not None and dense < s.least_density) or hag < -s.below or hag > s.above:
                kind = 7
            else:
                kind = 1
            counts[f"c{truth}{kind}"] += 1
        out[file] = counts
    return out


def test_counts_ranking_and_resuming(spark, points, tmp_path):
    rows, df = points
    folder = f"file://{tmp_path}/sweep"
    assert len({s.ground for s in GRID}) == 2 and len({s.name for s in GRID}) == 8
    sweep.run(df, GRID[:3], folder)
    times = {f: os.stat(f"{tmp_path}/sweep/ground/{f}/_SUCCESS").st_mtime_ns for f in os.listdir(f"{tmp_path}/sweep/ground")}
    assert len(times) == 2
    passes = set(os.listdir(f"{tmp_path}/sweep/results"))
    results = sweep.run(df, GRID, folder)
    # no ground is built again, and finished pairs are not tried again
    assert {f: os.stat(f"{tmp_path}/sweep/ground/{f}/_SUCCESS").st_mtime_ns for f in os.listdir(f"{tmp_path}/sweep/ground")} == times
    assert len(os.listdir(f"{tmp_path}/sweep/density")) == 1
    later = [f"{tmp_path}/sweep/results/{p}" for p in set(os.listdir(f"{tmp_path}/sweep/results")) - passes]
    tried = {(r["file"], r["setting"]) for p in later for r in spark.read.parquet(f"file://{p}").collect()}
    assert tried == {(f, s.name) for f in "ab" for s in GRID[3:]}
    got = {(r["file"], r["setting"]): {c: r[c] for c in sweep.COUNTS} for r in results.collect()}
    assert len(got) == 16
    for s in GRID:
        for file, want in plain(rows, s).items():
            assert got[file, s.name] == want, json.dumps(want)
    # a new file is tried, the others are not
    more = df.unionByName(df.where("granule = 'a'").selectExpr("pulse_index + 1000 AS pulse_index", "'c' AS granule", "x", "y", "refh", "snr", "ref_class"))
    before = set(os.listdir(f"{tmp_path}/sweep/results"))
    sweep.run(more, GRID[:1], folder)
    new = [f"file://{tmp_path}/sweep/results/{p}" for p in set(os.listdir(f"{tmp_path}/sweep/results")) - before]
    assert {r["file"] for p in new for r in spark.read.parquet(p).collect()} == {"c"}
    order = sweep.ranked(results, GRID).orderBy("rank").collect()
    assert [r["rank"] for r in order] == list(range(1, 9)) and all(a["mean_objective"] >= b["mean_objective"] - 1e-9 for a, b in zip(order, order[1:], strict=False))
    best = {r["file"]: r["objective"] for r in sweep.best_by_file(results).collect()}
    assert set(best) == {"a", "b"}


def test_scores(spark):
    counts = {"c11": 5, "c12": 1, "c17": 0, "c21": 2, "c22": 6, "c27": 0, "c71": 0, "c72": 0, "c77": 0}
    r = sweep.scored(spark.createDataFrame([("f", "s", *[counts[c] for c in sweep.COUNTS])], sweep.RESULT)).first()
    f1 = [2 * (5 / 7) * (5 / 6) / (5 / 7 + 5 / 6), 2 * (6 / 7) * (6 / 8) / (6 / 7 + 6 / 8), 0.0]
    assert abs(r["objective"] - (0.5 * f1[1] + 0.2 * sum(f1) / 3 - 0.1)) < 1e-12 and r["recall_7"] == 0.0
    assert classify.MODES[0] in sweep.PREFERENCE


def test_points_are_made_once(spark, points):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = points[1].withColumn("ref_class", F.when(F.col("pulse_index") % 10 < 8, F.col("ref_class")).when(F.col("pulse_index") % 10 == 8, 5))
    made = sweep.run(df.mapInArrow(passed, df.schema), GRID[:4], shared(spark, "once")).collect()
    assert seen.value == len(points[0])
    known = [r for r in points[0] if r[0] % 10 < 8]
    assert len(made) == 8 and all(sum(r[c] for c in sweep.COUNTS) == sum(k[1] == r["file"] for k in known) for r in made)


def test_points_are_not_joined_with_a_ground_that_was_made_of_them(spark, points):
    from pyspark.sql import functions as F

    own = points[1].select(F.col("pulse_index").alias("id"), F.col("granule").alias("file"), "x", "y", "refh", "snr", F.col("ref_class").alias("truth"))
    batch, folder = GRID[:2], shared(spark, "ground")
    assert batch[0].ground == batch[1].ground
    waiting = spark.createDataFrame([(f, s.name) for f in "ab" for s in batch], "file string, setting string")
    fresh, counts = set(), []
    for known in (fresh, fresh, set()):  # made, of this run, of an earlier one
        out = sweep._tried(spark, own, batch, waiting, batch[0].ground, None, folder, known)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftOuter") == (known is not fresh) and plan.count("isnan") <= 6
        counts.append(sorted(map(tuple, out.collect())))
    assert counts[0] == counts[1] == counts[2] and len(fresh) == 1
    for file, setting, *got in counts[0]:
        assert dict(zip(sweep.COUNTS, got, strict=True)) == plain(points[0], next(s for s in batch if s.name == setting))[file]
