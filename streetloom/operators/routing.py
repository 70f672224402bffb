"""Routing comparison: origin-destination samples, runs of path finders, metrics and rank statistics."""

from __future__ import annotations

import math
import time
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import distance
from ..kernels.finders import FINDERS, Graph
from ..tables import materialise, replace


def od_pairs(nodes: DataFrame, strata: tuple[float, ...], per_stratum: int) -> DataFrame:
    """(a, b, distance, stratum): the per_stratum pairs a < b of each distance band with the smallest md5 of 'a-b'.

    Bands are (strata[i - 1], strata[i]], from 0. Pairs beyond the last band never arise: nodes meet by grid cells."""
    from .grid import pairs_within

    pairs = pairs_within(nodes, strata[-1]).where("distance > 0")
    band: Column = F.lit(len(strata) - 1)
    for i in range(len(strata) - 2, -1, -1):
        band = F.when(F.col("distance") <= strata[i], i).otherwise(band)
    marked = pairs.withColumn("stratum", band).withColumn("h", F.md5(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))))
    return marked.withColumn("n", F.row_number().over(W.partitionBy("stratum").orderBy("h", "a", "b"))).where(F.col("n") <= per_stratum).drop("h", "n")


def bounded_distances(edges: DataFrame, sources: DataFrame, cutoff: float | None) -> DataFrame:
    """(source, v, cost) for all vertices within cutoff of each source (v), over undirected edges (u, v, length). Without
    a cutoff for all, sources bring their own in a column cutoff.

    Rounds of relaxation from the rows that changed last; at most as many as the longest such path has edges."""
    sources = sources.select("v", (F.lit(float(cutoff)) if cutoff is not None else F.col("cutoff")).alias("cutoff"))
    both = materialise(edges.select("u", "v", "length").union(edges.select("v", "u", "length")).groupBy("u", "v").agg(F.min("length").alias("length")), "paths-edges")
    best = materialise(sources.select(F.col("v").alias("source"), "v", F.lit(0.0).alias("cost"), "cutoff"), "paths-best")
    fresh = best
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("v", "u").join(both, "u").select("source", "v", (F.col("cost") + F.col("length")).alias("cost"), "cutoff").where(F.col("cost") <= F.col("cutoff"))
        step = step.groupBy("source", "v", "cutoff").agg(F.min("cost").alias("cost"))
        better = step.alias("s").join(best.alias("b"), ["source", "v"], "left").where("b.cost is null or s.cost < b.cost").select("source", "v", F.col("s.cost").alias("cost"), "s.cutoff")
        fresh = materialise(better, "paths-fresh")
        best = replace(best, best.union(fresh).groupBy("source", "v").agg(F.min("cost").alias("cost"), F.first("cutoff").alias("cutoff")), "paths-best")
    return best.drop("cutoff")


def path_similarity(nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame, cutoff: float, snap: float) -> DataFrame:
    """One row: forward, backward and their harmonic mean apls: how alike path lengths are in two graphs (APLS).

    For all pairs of nodes of a graph with a path of at most cutoff the difference to the path between the nearest nodes of
    the other graph, within snap, counts as a share of its length, one at most; a missing node or path counts one."""
    from .grid import nearest

    def one_way(n1, e1, n2, e2):
        near = nearest(n1.select(F.col("id").alias("own"), "x", "y"), n2.select("id", "x", "y"), snap, "own", "id")
        near = materialise(near.select("own", F.when(F.col("distance") <= snap, F.col("id")).alias("there")), "similar-nodes")
        to = lambda c: near.select(F.col("own").alias(c), F.col("there").alias(f"{c}_there"))
        here = bounded_distances(e1, n1.select(F.col("id").alias("v")), cutoff).where("cost > 0").withColumnsRenamed({"source": "a", "v": "b"})
        # A path that is longer by more than its own length counts one anyway.
        there = bounded_distances(e2, near.where("there is not null").select(F.col("there").alias("v")).distinct(), 2 * cutoff).withColumnsRenamed({"source": "a_there", "v": "b_there", "cost": "other"})
        both = here.join(to("a"), "a").join(to("b"), "b").join(there, ["a_there", "b_there"], "left")
        return both.agg((1 - F.avg(F.coalesce(F.least(F.lit(1.0), F.abs(F.col("cost") - F.col("other")) / F.col("cost")), F.lit(1.0)))).alias("s"))

    f = one_way(nodes, edges, other_nodes, other_edges).withColumnRenamed("s", "forward")
    b = one_way(other_nodes, other_edges, nodes, edges).withColumnRenamed("s", "backward")
    mean = F.try_divide(2 * F.col("forward") * F.col("backward"), F.col("forward") + F.col("backward"))
    return f.crossJoin(b).withColumn("apls", mean)  # a row each


_RUN = "area string, pair long, algo string, seed int, path array<long>, cost double, expanded long, runtime_s double"


def run_finders(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, algorithms: Iterable[str], seeds: Iterable[int] = (1,), parts: int = 8) -> DataFrame:
    """Every algorithm and seed on every pair (area, pair, a, b); nodes (area, id, x, y), edges (area, u, v, length).

    Pairs are dealt into `parts` parts per area. A task holds one area's graph and one part's pairs."""
    names, seeds = list(algorithms), list(seeds)
    if unknown := [n for n in names if n not in FINDERS]:
        raise ValueError(f"unknown algorithm {unknown[0]!r}; known are {', '.join(FINDERS)}")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    no = lambda t, n: F.lit(None).cast(t).alias(n)
    n = nodes.select("area", copies, F.lit(0).alias("kind"), F.col("id").alias("a"), no("long", "b"), "x", "y", no("long", "pair"))
    e = edges.select("area", copies, F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("length").alias("x"), no("double", "y"), no("long", "pair"))
    graph = n.unionByName(e)
    dealt = pairs.select("area", F.pmod(F.xxhash64("pair"), F.lit(parts)).cast("int").alias("part"), "pair", "a", "b")

    def work(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _RUN.split(", ")]
        if graph.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        at, on = graph[graph["kind"] == 0], graph[graph["kind"] == 1]
        g = Graph.of(zip(at["a"], at["x"], at["y"], strict=True), zip(on["a"], on["b"].astype("int64"), on["x"], strict=True))
        rows = []
        for r in asked.itertuples():
            for name in names:
                for seed in seeds:
                    began = time.perf_counter()
                    path, cost, expanded = FINDERS[name](g, int(r.a), int(r.b), seed)
                    rows.append((r.area, r.pair, name, seed, path, cost, expanded, time.perf_counter() - began))
        return pd.DataFrame(rows, columns=columns)

    return graph.groupBy("area", "part").cogroup(dealt.groupBy("area", "part")).applyInPandas(work, _RUN)


def metrics(runs: DataFrame, exact: str = "dijkstra") -> DataFrame:
    """By algorithm: success rate, mean optimality gap against the exact one, mean runtime and expanded nodes."""
    best = runs.where(F.col("algo") == exact).groupBy("area", "pair").agg(F.min("cost").alias("best"))
    found = F.size("path") > 0
    gap = F.when(found & (F.col("best") > 0), F.col("cost") / F.nullif("best", F.lit(0.0)) - 1)
    return runs.join(best, ["area", "pair"]).groupBy("algo").agg(F.avg(found.cast("int")).alias("success"), F.avg(gap).alias("gap"), F.avg("runtime_s").alias("runtime_s"), F.avg("expanded").alias("expanded"))


def mean_ranks(scores: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """(block, method, rank): ranks inside each block, smaller values first, ties sharing their mean rank."""
    w = W.partitionBy(block)
    low = F.rank().over(w.orderBy(value))
    same = F.count("*").over(W.partitionBy(block, value))
    return scores.select(block, method, (low + (same - 1) / 2).alias("rank"))


def friedman(scores: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """One row: blocks n, methods k, chi2 and the critical difference of mean ranks (Nemenyi, 5 %), over complete blocks."""
    ranks = mean_ranks(scores, block, method, value)
    k = ranks.select(method).distinct().count()
    full = ranks.join(ranks.groupBy(block).agg(F.count("*").alias("c")).where(F.col("c") == k), block, "left_semi")
    sums = full.groupBy(method).agg(F.avg("rank").alias("r"), F.count("*").alias("n"))
    total = sums.agg(F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"))
    chi2 = 12 * F.col("n") / (k * (k + 1)) * (F.col("s") - k * (k + 1) ** 2 / 4)
    # Studentized range at 5 % for 2 to 10 methods, over the root of two.
    critical = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}.get(k)
    cd = F.lit(critical) * F.sqrt(F.lit(k * (k + 1)) / (6 * F.col("n"))) if critical else F.lit(None).cast("double")
    return total.select("n", F.lit(k).alias("k"), chi2.alias("chi2"), cd.alias("critical_difference"))


def pareto_front(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in x or y without losing in the other (both are minimised); equal rows stay.

    Sorted by x in ranges: a row stays if no row ahead of it has a y as small. Ranges first give their least y."""
    small = rows.groupBy(x).agg(F.min(y).alias("low"))
    placed = materialise(small.repartitionByRange(x).sortWithinPartitions(x).withColumn("_p", F.spark_partition_id()), "front-placed")
    ahead = placed.groupBy("_p").agg(F.min("low").alias("m"))
    ahead = ahead.select("_p", F.min("m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("before"))  # a row per partition
    inner = F.min("low").over(W.partitionBy("_p").orderBy(x).rowsBetween(W.unboundedPreceding, -1))
    front = placed.withColumn("inner", inner).join(F.broadcast(ahead), "_p").where(F.col("low") < F.coalesce(F.least("inner", "before"), F.lit(math.inf)))
    return rows.join(front.select(x, F.col("low").alias(y)), [x, y], "left_semi")


def detour_ratio(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (a, b, cost) with the straight distance and their ratio."""
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    straight = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return runs.join(at("a"), "a").join(at("b"), "b").withColumn("straight", straight).withColumn("ratio", F.try_divide("cost", "straight")).drop("ax", "ay", "bx", "by")
