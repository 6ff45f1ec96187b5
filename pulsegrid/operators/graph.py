"""Connected components of an edge table by distributed union-find, in DataFrame operations alone.

Each round hooks every node to its smallest neighbour, follows the parents until they are roots, and contracts the
edges to roots; the edges shrink at least geometrically on any but contrived graphs, so a few rounds do. Each step is a
table in the shared folder. Nulls on either end are ignored, repeated edges count once, and self-loops are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.lineage import shared

#: Rows of a small table that one partition is worth.
SMALL_ROWS = 50_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The written table and its number of rows; a small one goes on in few partitions, so that what follows makes few
    tasks and files. A checkpoint would keep the size that the planner expects, the product of the sizes of a join's sides: a number
    of twice as many digits after each step, which fills the driver."""
    path = shared(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    n = out.count()
    return out.coalesce(n // SMALL_ROWS + 1), n


def _followed(p: DataFrame) -> DataFrame:
    """Parents replaced by their parents, where they have one."""
    up = p.select(F.col("node").alias("_n"), F.col("parent").alias("_up"))
    return p.join(up, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("moved"))


def _rooted(p: DataFrame) -> DataFrame:
    """Parents followed until all are roots; depth halves with each turn."""
    while True:
        p, _ = counted(_followed(p))
        still = p.where("moved").isEmpty()
        p = p.select("node", "parent")
        if still:
            return p


def _relabel(edges: DataFrame, p: DataFrame, column: str) -> DataFrame:
    found = p.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return edges.join(found, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_p", column)).select("a", "b")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge (a, b) to another; component is the smallest node that can be reached."""
    edges, n = counted(_ordered(edges.where("a IS NOT NULL AND b IS NOT NULL")))
    rounds = []
    while n:
        p = _rooted(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        rounds.append(p)
        edges, n = counted(_ordered(_relabel(_relabel(edges, p, "a"), p, "b")))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # a node hooked in one round has its root hooked in a later one, or not at all
    labels = rounds[-1]
    for p in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        labels, _ = counted(p.join(later, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent")).unionByName(labels))
    roots = labels.select(F.col("parent").alias("node"), "parent").distinct()
    return labels.unionByName(roots).withColumnRenamed("parent", "component")
