"""Queries and their oracles on tables that the smallest scale does not hold: limits met exactly, large keys, flat tops."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import classify
from pulsegrid.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


def compared(spark, folder, name, **changed):
    """Rows of the query and of its oracle, where tables of the smallest scale are replaced by SQL over them."""
    duck = duckdb.connect()
    for table, text in changed.items():
        duck.sql(f"COPY ({text.format(f"'{DATA}/{table}.parquet'")}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    text = lambda frame: sorted(map(repr, frame[sorted(got.columns)].astype(object).where(frame.notna(), None).values.tolist()))
    return text(got), text(want)


def test_half_counts_are_cut_off(spark, tmp_path):
    got, want = compared(spark, tmp_path, "f2_normalise", lineitem="SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN 50000.7 ELSE l_extendedprice END AS l_extendedprice) FROM {}")
    assert got == want


def test_a_height_on_a_limit_is_on_it(spark):
    # 1.5 apart, but not in doubles
    points = spark.createDataFrame([(16.12, 14.62), (16.19, 14.69), (16.33, 14.83), (16.4, 14.9)], "refh double, ground double")
    assert len({h - g for h, g in points.collect()}) > 1
    found = classify.classify(points, classify.CascadeOptions(mode="height_only", scanline_noise=False)).collect()
    assert {(r["hag"], r["class"]) for r in found} == {(1.5, classify.GROUND)}


def test_instruments_above_the_levels(spark, tmp_path):
    got, want = compared(spark, tmp_path, "f13_excess_path", supplier="SELECT * REPLACE (s_suppkey * 3700 AS s_suppkey) FROM {}")
    assert got == want and any("not_bracketed" in r for r in got) and any("integrated" in r for r in got)


def test_flat_tops(spark, tmp_path):
    got, want = compared(spark, tmp_path, "v19_morphology", embeddings="SELECT * REPLACE (list_transform(embedding, lambda x: CAST(round(x, 1) AS FLOAT)) AS embedding) FROM {}")
    assert got == want
