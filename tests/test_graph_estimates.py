"""The sizes that the planner expects of union-find's tables stay those of the tables, whatever the number of steps."""

from pulsegrid.operators import graph


def test_estimates_do_not_grow_with_the_steps(spark):
    chain = spark.range(300).selectExpr("xxhash64(id) AS a", "xxhash64(id + 1) AS b")
    found = graph.components(chain)
    assert found.count() == 301 and found.select("component").distinct().count() == 1
    step, n = graph.counted(found.join(found.withColumnRenamed("component", "c"), "node"))
    assert n == 301 and float(str(step._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1e6
