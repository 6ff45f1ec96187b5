"""Every query that has an oracle gives the oracle's rows at the smallest scale; the others run."""

import os

import duckdb
import pytest

from pulsegrid.plans import catalog
from pulsegrid.plans.binding import SOURCES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in SOURCES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame, columns):
    return sorted(map(repr, ([None if v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in frame[columns].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for frame in (got, want):
        for c in columns:
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["j13_local_features", "r4_hole_filling", "g13_rule_scoring", "a45_noise_calibration", "s7_attributes"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
