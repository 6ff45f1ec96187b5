"""Quotas along an order, and the choice of a configuration."""

import numpy as np
import pytest

from pulsegrid.operators import sampling, statistics
from pulsegrid.operators.lineage import shared


@pytest.mark.parametrize("budget, parts", [(0, 1), (37, 1), (37, 5), (150, 3), (10_000, 2)])
def test_quotas(spark, budget, parts):
    shared(spark, "")
    random_ = np.random.default_rng(6)
    rows = [(int(g), int(i)) for i, g in enumerate(random_.choice(9, 400, p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02]))]
    got = {tuple(r) for r in sampling.proportional(spark.createDataFrame(rows, "g bigint, i bigint"), "g", ["i"], budget, parts).collect()}
    held = {g: [i for h, i in rows if h == g] for g in sorted({g for g, _ in rows})}
    n = min(budget, 400)
    exact = np.array([len(v) for v in held.values()]) * (n / 400)
    quota = np.floor(exact).astype(int)
    quota[np.argsort(-(exact - quota), kind="stable")[: n - quota.sum()]] += 1
    want = set()
    for k, (g, own) in enumerate(held.items()):
        if quota[k]:
            places = np.floor((np.arange(quota[k]) + k * sampling.GOLDEN % 1.0) * len(own) / quota[k]).astype(int)
            want |= {(g, own[p]) for p in places}
    assert got == want and len(got) == n


def test_evidence_comes_before_numbers(spark):
    metrics = spark.createDataFrame([("a", "candidate_selection", 0.1), ("b", "candidate_selection", 0.5), ("c", "candidate_selection", 0.3), ("d", "candidate_selection", 0.01)], "candidate string, role string, rmse double")
    evidence = lambda *rows: spark.createDataFrame(rows, "candidate string, verified boolean, complete boolean, provisional boolean, rank int")
    chosen = lambda e: statistics.select_configuration(metrics, e).first()["candidate"]
    assert chosen(evidence(("a", False, True, True, 9), ("b", True, True, False, 1), ("c", True, True, False, 1), ("d", True, False, True, 9))) == "c"
    assert chosen(evidence(("a", False, True, True, 3), ("b", False, True, True, 5), ("d", False, True, False, 9))) == "b"
    with pytest.raises(ValueError, match="no verified"):
        chosen(evidence(("a", False, True, False, 3)))
    with pytest.raises(ValueError, match="independent_test"):
        statistics.select_configuration(metrics.unionByName(spark.createDataFrame([("a", "independent_test", 0.1)], metrics.schema)), evidence(("a", True, True, True, 1)))
