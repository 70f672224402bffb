"""Connected components of links between documents or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components as graph


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): each vertex of edges (a, b) with another one, and the smallest vertex reachable from it.

    Nulls and self-loops are ignored; no edges give no rows."""
    return graph.components(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
