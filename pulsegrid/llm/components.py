"""Connected components of links, for the operators that join copies: the library's union-find in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.llm.common import ready
from pulsegrid.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached. Nulls on either
    end and self-loops are ignored; repeated edges count once."""
    ready(edges.sparkSession)
    return graph.components(edges)
