"""Queries over whole tables or cells whose plans hold no group's values in one buffer, nor spread cells over a square."""

import os

import pytest

from pulsegrid.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.mark.parametrize("name, absent", [("p2_staged_mask", "percentile("), ("e20_crosscheck", "percentile("), ("p9_reason_bits", "Window"), ("a47_noise_counts", "Window"), ("r6_smooth", "Cross")])
def test_plan(spark, name, absent):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert absent not in plan
