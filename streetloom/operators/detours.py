"""Links across narrow gaps between streets that are close but far apart by road."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..kernels.paths import adjacency, crossing, within
from ..tables import materialise
from .components import components
from .grid import in_cells, in_near_cells, pairs_within, without_crossing, without_meeting


def limit(gap, max_detour: float):
    """The longest way by road that a gap may have without a link."""
    return max_detour * F.greatest(gap, F.lit(10.0))


def reaches(pairs: DataFrame, max_detour: float) -> DataFrame:
    """(u, cutoff): how far to search from each first node of pairs (u, gap): the largest limit of its pairs."""
    return pairs.groupBy("u").agg(F.max(limit(F.col("gap"), max_detour)).alias("cutoff"))


def far_pairs(pairs: DataFrame, edges: DataFrame, max_detour: float) -> DataFrame:
    """Those of pairs (u, v, gap) whose way by road is over their limit, by one bounded search from each first node."""
    from .routing import bounded_distances

    pairs = materialise(pairs, "far-pairs")
    found = bounded_distances(edges.select("u", "v", "length"), reaches(pairs, max_detour).withColumnRenamed("u", "v"), None)
    near = found.select(F.col("source").alias("u"), "v", "cost")
    return pairs.join(near, ["u", "v"], "left").where(F.coalesce(F.col("cost") > limit(F.col("gap"), max_detour), F.lit(True))).select(*pairs.columns)


def link_detours(nodes: DataFrame, edges: DataFrame, barriers: DataFrame, max_gap: float = 100.0, max_detour: float = 10.0, many: int = 10_000) -> DataFrame:
    """New straight edges (u, v, length) between nodes at most max_gap apart whose road distance is more than max_detour
    times their gap (10 m at least). A link may not touch a barrier (segments ax, ay, bx, by), cross a street or cross an
    earlier link; candidates are taken by gap and ends, and distances count the links already taken.

    Gap, barrier and street tests are joins. Only candidates that are near each other can influence one another: the
    cutoff is max_detour * max_gap, so a path that decides on a pair stays within half of it, and gaps, of the pair. The
    rest therefore falls into clusters of candidates within reach of each other, and the order-dependent part runs per
    cluster, on the edges around it. Links only shorten ways, so pairs that are near by road now stay so: where there are
    more than `many` candidates, searches from all first nodes at once leave those out before, and clusters stay small;
    fewer are not worth these rounds. The result is the same."""
    place = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    pairs = pairs_within(nodes, max_gap).withColumnsRenamed({"a": "u", "b": "v", "distance": "gap"}).join(place("u"), "u").join(place("v"), "v")
    links = materialise(pairs.select(F.struct("u", "v").alias("pair"), "u", "v", "gap", F.col("ux").alias("ax"), F.col("uy").alias("ay"), F.col("vx").alias("bx"), F.col("vy").alias("by")), "detour-pairs")
    size = max(2 * max_gap, 1.0)
    links = without_meeting(links, barriers, L.intersects, size, "pair")
    links = materialise(without_crossing(links, edges, "eid", size, "pair"), "detour-links")
    n = links.count()
    if n > many:
        links = materialise(far_pairs(links, edges, max_detour), "detour-far")
        n = links.count()
    if not n:
        return links.select("u", "v", F.col("gap").alias("length"))

    reach = max_detour * max(max_gap, 10.0) + 2 * max_gap
    middle = links.select("pair", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    # Clusters by cells: candidates in touching cells of the reach's size belong together.
    cells = in_cells(middle, reach).select("cx", "cy").distinct().withColumn("c", F.struct("cx", "cy"))
    touching = in_near_cells(cells.select("c", (F.col("cx") * reach + reach / 2).alias("x"), (F.col("cy") * reach + reach / 2).alias("y")), reach).join(cells.select("cx", "cy", F.col("c").alias("d")), ["cx", "cy"]).select(F.col("c").alias("u"), F.col("d").alias("v"))
    named = materialise(components(touching).select(F.col("v.cx").alias("cx"), F.col("v.cy").alias("cy"), F.struct("comp.cx", "comp.cy").cast("string").alias("cluster")), "detour-clusters")
    candidates = in_cells(middle, reach).join(named, ["cx", "cy"]).select("pair", "cluster").join(links, "pair")
    # Streets of a cluster: those with a vertex in one of its cells or beside them.
    around = in_near_cells(named.select("cluster", (F.col("cx") * reach + reach / 2).alias("x"), (F.col("cy") * reach + reach / 2).alias("y")), reach).select("cluster", "cx", "cy").distinct()
    ends = in_cells(edges.select("eid", F.explode("line").alias("q")).select("eid", "q.x", "q.y"), reach).select("eid", "cx", "cy").distinct()
    streets = ends.join(around, ["cx", "cy"]).select("cluster", "eid").distinct().join(edges.select("eid", "u", "v", "length"), "eid")
    no = lambda t: F.lit(None).cast(t)
    rows = candidates.select("cluster", F.lit(True).alias("link"), "u", "v", F.col("gap").alias("d"), "ax", "ay", "bx", "by").unionByName(streets.select("cluster", F.lit(False).alias("link"), "u", "v", F.col("length").alias("d"), *(no("double").alias(c) for c in ("ax", "ay", "bx", "by"))))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = adjacency(pdf.loc[~pdf["link"], ["u", "v", "d"]].itertuples(index=False, name=None))
        taken: list[tuple] = []
        for r in pdf[pdf["link"]].sort_values(["d", "u", "v"]).itertuples():
            most = max_detour * max(r.d, 10.0)
            if within(graph, r.u, most, r.v).get(r.v, float("inf")) <= most:
                continue
            a, b = (r.ax, r.ay), (r.bx, r.by)
            if any(crossing(a, b, c, d) for _, _, _, c, d in taken):
                continue
            taken.append((r.u, r.v, r.d, a, b))
            graph.setdefault(r.u, []).append((r.v, r.d))
            graph.setdefault(r.v, []).append((r.u, r.d))
        return pd.DataFrame([t[:3] for t in taken], columns=["u", "v", "length"])

    return rows.groupBy("cluster").applyInPandas(greedy, "u long, v long, length double")
