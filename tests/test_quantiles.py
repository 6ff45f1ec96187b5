"""Exact grouped quantiles against numpy, with every narrowing step forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import quantiles, statistics
from pulsegrid.operators.lineage import cut

PS = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def rows():
    random_ = np.random.default_rng(0)
    n = 20_000
    frame = pd.DataFrame({"g": np.where(random_.random(n) < 0.8, 0, random_.integers(1, 40, n)).astype(float), "x": random_.normal(size=n), "y": np.where(random_.random(n) < 0.5, 1.0, 2.0), "z": np.exp(random_.normal(size=n) * 20)})
    frame.loc[:6000, "x"] = 0.0  # a common value
    frame.loc[::17, "x"] = np.nan
    frame.loc[frame.g == 39, "g"] = np.nan
    frame.loc[frame.g == 38, "x"] = np.nan  # a group without a value
    return frame


@pytest.fixture(scope="module")
def table(spark, rows):
    return cut(spark.createDataFrame(rows).withColumn("g", F.when(~F.isnan("g"), F.col("g").cast("int"))).repartition(5))


@pytest.mark.parametrize("most, accuracy, bins", [(10_000, 5000, 1024), (50, 50, 16), (1, 50, 64)])
def test_groups(table, rows, most, accuracy, bins):
    got = quantiles.grouped_quantiles(table, ["g"], {"x": "x", "y": "y", "z": F.col("z") * 2}, PS, most, accuracy, bins).toPandas()
    assert len(got) == rows.g.nunique(dropna=False)
    for r in got.itertuples():
        own = rows[rows.g.isna()] if r.g != r.g or r.g is None else rows[rows.g == r.g]
        for name, v in (("x", own.x.dropna()), ("y", own.y), ("z", own.z * 2)):
            assert getattr(r, f"{name}_n") == len(v)
            if len(v):
                np.testing.assert_allclose([getattr(r, f"{name}_q{i}") for i in range(len(PS))], np.quantile(v, PS), rtol=1e-12)
            else:
                assert getattr(r, f"{name}_q0") != getattr(r, f"{name}_q0") or getattr(r, f"{name}_q0") is None


@pytest.mark.parametrize("most", [10_000, 20])
def test_one_group_of_all_rows(table, rows, most):
    row = quantiles.grouped_quantiles(table, [], {"x": "x"}, PS, most, 50, 8).first()
    np.testing.assert_allclose([row[f"x_q{i}"] for i in range(len(PS))], np.quantile(rows.x.dropna(), PS), rtol=1e-12)
    few = quantiles.grouped_quantiles(table.limit(0), [], {"x": "x"}, [0.5]).collect()
    assert [tuple(r) for r in few] == [(0, None)]
    assert quantiles.grouped_quantiles(table.limit(0), ["g"], {"x": "x"}, [0.5]).count() == 0


@pytest.mark.parametrize("most", [10_000, 30])
def test_median_and_deviation(table, rows, most):
    got = quantiles.grouped_median_nmad(table, ["g"], "x", 0.25, most=most, accuracy=50).toPandas()
    for r in got.itertuples():
        v = (rows[rows.g.isna()] if r.g != r.g or r.g is None else rows[rows.g == r.g]).x.dropna()
        if len(v):
            assert r.n == len(v) and abs(r.med - v.median()) < 1e-12 and abs(r.nmad - max(0.25, 1.4826 * (v - v.median()).abs().median())) < 1e-12


def test_no_bracket_is_searched_for_ever(spark):
    """Half of the values lie at either end, so the two middle ranks fall into the first and the last bin."""
    df = cut(spark.range(4000).select((F.col("id") % 2).cast("double").alias("v")))
    assert statistics.quantile_values(df, "v", [0.5], accuracy=50, bins=8, most=10) == [0.5]
    assert quantiles.grouped_quantiles(df, [], {"v": "v"}, [0.5], 10, 50, 8).first()["v_q0"] == 0.5


def test_metrics_of_groups_equal_those_of_tables(table):
    whole = statistics.distribution_metrics(table, "x", 1).first()
    group = statistics.grouped_metrics(table.withColumn("k", F.lit(1)), ["k"], "x", 1).first()
    for c in whole.asDict():
        assert abs(whole[c] - group[c]) < 1e-9


def test_small_groups_are_not_joined_with_their_counts(spark):
    df = spark.range(2000).selectExpr("id % 500 AS g", "CASE WHEN id % 500 <> 7 THEN CAST(id AS DOUBLE) END AS v")
    found = quantiles.grouped_quantiles(df, ["g"], {"v": "v"}, [0.5])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["g"]: (r["v_n"], r["v_q0"]) for r in found.collect()}
    assert len(rows) == 500 and rows[7] == (0, None) and rows[3] == (4, 753.0)
