"""Weak and strong components of edge tables, by label rounds in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import free, materialise, materialise_counting, replace


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, comp): each vertex of edges (u, v) with the smallest vertex reachable from it, directions ignored.

    Without `vertices` (column v) only ends of edges come back, self-loops included. Each round takes the smallest label
    of a vertex and its neighbours and follows it once more, by the labels of the round before, so chains need a
    logarithmic number of rounds. A round is one job, which also counts the labels that change."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = materialise(both.union(both.select("b", "a")).distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("low"))
        roots = labels.select(F.col("v").alias("low"), F.col("comp").alias("root"))
        new = low.join(roots, "low").select("v", "old", F.least("low", "root").alias("comp"))
        new, changed = materialise_counting(new, "cc-labels", F.col("old") != F.col("comp"))
        free(labels)
        if not changed:
            break
        labels = new
    free(both)
    found = new.select("v", "comp")
    if vertices is None:
        return found
    return vertices.select("v").distinct().join(found, "v", "left").withColumn("comp", F.coalesce("comp", "v"))


def ranked(parts: DataFrame) -> DataFrame:
    """(v, comp, rank): components numbered 0, 1, ... in the order of their smallest vertices, over all of them."""
    from .roads import dense_ids

    return parts.join(dense_ids(parts.select("comp").distinct(), "comp", "rank"), "comp").select("v", "comp", "rank")


def arcs(edges: DataFrame) -> DataFrame:
    """Directed arcs (u, v) of edges (u, v, oneway): two-way edges count in both directions."""
    return edges.select("u", "v").union(edges.where(~F.coalesce(F.col("oneway"), F.lit(False))).select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _spread(labels: DataFrame, arcs_: DataFrame) -> DataFrame:
    """Carry the smallest label along arcs until nothing changes; labels (v, c) of all vertices.

    Only vertices whose label has changed pass it on."""
    labels = materialise(labels, "scc-labels")
    fresh = labels
    while True:
        step = arcs_.join(fresh.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("m"))
        better, n = materialise_counting(labels.join(step, "v").where("m < c").select("v", F.col("m").alias("c")), "scc-better", F.lit(True))
        if fresh is not labels:
            free(fresh)
        if not n:
            return labels
        labels = replace(labels, labels.join(better.withColumnRenamed("c", "m"), "v", "left").select("v", F.coalesce("m", "c").alias("c")), "scc-labels")
        fresh = better


def strong_components(arcs_: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, scc): the strongly connected component of each vertex, named by its smallest vertex.

    Colouring: every vertex takes the smallest vertex that reaches it; the vertices of a colour that reach its root again
    are the root's component. They leave, and the rest goes on. Vertices without an arc in or out leave at once."""
    left = materialise(vertices.select("v").distinct(), "scc-left")
    edges = materialise(arcs_.where("u <> v").distinct(), "scc-arcs")
    done = None

    def finish(rows: DataFrame) -> None:
        nonlocal done, left, edges
        rows = materialise(rows, "scc-done")
        done = rows if done is None else done.union(rows)
        left = materialise(left.join(rows, "v", "left_anti"), "scc-left")
        keep = left.select("v")
        edges = materialise(edges.join(keep, "v", "left_semi").join(keep.withColumnRenamed("v", "u"), "u", "left_semi").select("u", "v"), "scc-arcs")

    while not left.isEmpty():
        ends = edges.select(F.col("u").alias("v")).intersect(edges.select("v"))
        single = left.join(ends, "v", "left_anti")
        if not single.isEmpty():
            finish(single.select("v", F.col("v").alias("scc")))
            continue
        colour = materialise(_spread(left.select("v", F.col("v").alias("c")), edges), "scc-colour")
        # Backwards inside each colour, from its root.
        inside = edges.join(colour.withColumnsRenamed({"v": "u", "c": "cu"}), "u").join(colour, "v").where("cu = c").select(F.col("v").alias("u"), F.col("u").alias("v"))
        inside = materialise(inside, "scc-inside")
        reached = _spread(colour.select("v", F.when(F.col("v") == F.col("c"), 0).otherwise(1).alias("c")), inside).where("c = 0").select("v")
        finish(reached.join(colour, "v").select("v", F.col("c").alias("scc")))
    return done if done is not None else vertices.select("v", F.col("v").alias("scc"))


def largest(parts: DataFrame, label: str, *by: str) -> DataFrame:
    """The rows (v, label) of the largest label, of each group `by` if given; the smaller label on ties."""
    n = parts.groupBy(label, *by).agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.max(F.struct("n", (-F.col(label)).alias("m"), F.col(label).alias("best"))).getField("best").alias(label))
    return parts.join(top, [label, *by], "left_semi")


def strong_part(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v): the largest strongly connected component of edges (u, v, oneway)."""
    return largest(strong_components(arcs(edges), vertices), "scc").select("v")


def repaired(edges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """edges (eid, u, v, oneway) -> (eid): the one-way edges to open so that each part stays strongly connected.

    In each round the largest strong component of every weakly connected part is found, and one-way edges that touch a
    vertex outside of it are opened."""
    edges = materialise(edges.select("eid", "u", "v", F.coalesce(F.col("oneway"), F.lit(False)).alias("oneway")), "repair-edges")
    vertices = materialise(edges.select("u").union(edges.select("v")).distinct().toDF("v"), "repair-vertices")
    weak = materialise(components(edges, vertices), "repair-weak")
    reverted = None
    for _ in range(max_rounds):
        strong = strong_components(arcs(edges), vertices).join(weak, "v")
        good = largest(strong, "scc", "comp").select("v")
        bad = materialise(vertices.join(good, "v", "left_anti"), "repair-bad")
        if bad.isEmpty():
            break
        touched = edges.where("oneway").select("eid", F.explode(F.array("u", "v")).alias("v")).join(bad, "v", "left_semi").select("eid").distinct()
        touched = materialise(touched, "repair-touched")
        if touched.isEmpty():
            break
        reverted = touched if reverted is None else reverted.union(touched)
        edges = materialise(edges.join(touched.withColumn("hit", F.lit(True)), "eid", "left").withColumn("oneway", F.col("oneway") & F.col("hit").isNull()).drop("hit"), "repair-edges")
    return reverted if reverted is not None else edges.select("eid").limit(0)
