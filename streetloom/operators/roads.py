"""Road graph clean-up on tables nodes (id, x, y) and edges (eid, u, v, length, line, bridged)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import XY
from ..tables import materialise, replace
from .components import components
from .grid import knn_within


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree); a self-loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).select("id"), "id", "left_semi")


def prune_spurs(edges: DataFrame, min_length: float) -> DataFrame:
    """Drop edges shorter than min_length with an end of degree 1, again and again until none is left; loops stay."""
    edges = materialise(edges, "spurs")
    while True:
        ends = degrees(edges).where("degree = 1").select("id")
        short = edges.where((F.col("length") < min_length) & (F.col("u") != F.col("v"))).select("eid", F.explode(F.array("u", "v")).alias("id"))
        gone = materialise(short.join(ends, "id", "left_semi").select("eid").distinct(), "spurs-gone")
        if gone.isEmpty():
            return edges
        edges = replace(edges, edges.join(gone, "eid", "left_anti"), "spurs")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


def merge_junctions(nodes: DataFrame, edges: DataFrame, max_length: float) -> tuple[DataFrame, DataFrame]:
    """Join junctions (degree 3 or more) that an edge shorter than max_length links: one node in the middle of each group.

    Every edge with both ends in one group goes, however long; lines keep their points."""
    junction = degrees(edges).where("degree >= 3").select("id")
    short = edges.where(F.col("length") < max_length)
    short = short.join(junction.withColumnRenamed("id", "u"), "u", "left_semi").join(junction.withColumnRenamed("id", "v"), "v", "left_semi")
    groups = materialise(components(short.select("u", "v")), "junction-groups")
    named = nodes.join(groups.withColumnRenamed("v", "id"), "id", "left").withColumn("rep", F.coalesce("comp", "id"))
    merged = named.groupBy(F.col("rep").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    to = lambda c: groups.select(F.col("v").alias(c), F.col("comp").alias(f"{c}_to"))
    moved = edges.join(to("u"), "u", "left").join(to("v"), "v", "left")
    moved = moved.withColumn("inside", F.col("u_to") == F.col("v_to")).withColumn("u", F.coalesce("u_to", "u")).withColumn("v", F.coalesce("v_to", "v"))
    return merged, moved.where("inside is null or not inside").select(*edges.columns)


def link_components(nodes: DataFrame, edges: DataFrame, max_gap: float, k: int = 32) -> DataFrame:
    """New straight edges that join parts at most max_gap apart: u, v, length, one for each merge (k counts a junction itself).

    Rounds as in a minimum spanning forest by parts: each part offers its closest pair with another part, of the k nearest
    junctions of each junction, and the offers that close no circle are taken in the order of gap and ends. The offers of a
    round are one per part; circles are found by comparing offers, as in a round two parts can only choose each other or
    form chains, except for ties, which the order breaks."""
    links = None
    parts = materialise(components(edges.select("u", "v"), nodes.select(F.col("id").alias("v"))), "link-parts")
    a = nodes.select(F.col("id").alias("u"), "x", "y")
    near = materialise(knn_within(a, nodes.select(F.col("id").alias("v"), "x", "y"), max_gap, k, "u", "v").where("u <> v").select("u", "v", F.col("distance").alias("gap")), "link-near")
    while True:
        offered = near.join(parts.withColumnsRenamed({"v": "u", "comp": "cu"}), "u").join(parts.withColumnRenamed("comp", "cv"), "v").where("cu <> cv")
        key = F.struct("gap", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        best = offered.groupBy("cu").agg(F.min(F.struct(key.alias("key"), "cv")).alias("best")).select("cu", "best.cv", F.col("best.key.gap").alias("gap"), F.col("best.key.a").alias("a"), F.col("best.key.b").alias("b"))
        best = materialise(best, "link-best")
        if best.isEmpty():
            return links if links is not None else near.select("u", "v", F.col("gap").alias("length")).limit(0)
        # Keys (gap, a, b) are in strict order, so the choices can't form a circle of three or more parts.
        chosen = best.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("gap").alias("length")).distinct()
        links = chosen if links is None else links.union(chosen)
        joined = components(best.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        parts = materialise(parts.join(joined.select(F.col("v").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("v", F.coalesce("root", "comp").alias("comp")), "link-parts")


_EDGE = f"eid long, u long, v long, length double, line array<{XY}>, bridged boolean"


def contract_chains(edges: DataFrame) -> DataFrame:
    """Join the two edges at each node of degree 2, unless one is a loop, both lead to the same node or their bridged flags
    differ: lengths add up and lines follow each other. A ring keeps two of its nodes, as the last two edges share both ends.

    Nodes that allow the merge in the input graph form chains by components; a chain is put together in one task, which
    holds that chain's edges only."""
    edges = materialise(edges.select("eid", "u", "v", "length", "line", "bridged"), "chain-edges")
    ends = edges.where("u <> v").select("eid", "bridged", F.col("u").alias("id"), F.col("v").alias("other")).union(edges.where("u <> v").select("eid", "bridged", "v", "u"))
    loops = edges.where("u = v").select(F.col("u").alias("id")).distinct()
    at = ends.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("bridged").alias("kinds"), F.min("eid").alias("e1"), F.max("eid").alias("e2"))
    inner = materialise(at.where("n = 2 and kinds = 1").join(loops, "id", "left_anti").select("id", "e1", "e2"), "chain-inner")
    groups = materialise(components(inner.select(F.col("e1").alias("u"), F.col("e2").alias("v"))).select(F.col("v").alias("eid"), F.col("comp").alias("chain")), "chain-groups")
    # An edge says of its own ends whether they are inner ones; no row carries more of the chain than that.
    flag = lambda c: inner.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_in"))
    rows = edges.join(groups, "eid").join(flag("u"), "u", "left").join(flag("v"), "v", "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        inside: set = set()
        edge: dict = {}
        touch: dict = {}
        for r in pdf.itertuples():
            u, v = int(r.u), int(r.v)
            # A line is kept as a tree of pieces (points, or two trees), with a mark if it is read backwards.
            edge[r.eid] = (u, v, r.length, ([(p["x"], p["y"]) for p in r.line], False))
            inside.update(n for n, there in ((u, r.u_in), (v, r.v_in)) if there is True)
            touch.setdefault(u, []).append(r.eid)
            touch.setdefault(v, []).append(r.eid)
        for node in sorted(inside):  # in node order; what a merge makes is an edge again
            e, f = touch[node]
            a = edge[e][0] if edge[e][1] == node else edge[e][1]
            b = edge[f][0] if edge[f][1] == node else edge[f][1]
            if e == f or a == b:
                continue
            first = _turned(edge[e][3], edge[e][1] != node)
            second = _turned(edge[f][3], edge[f][0] != node)
            edge[e] = (a, b, edge[e][2] + edge[f][2], ((first, second), False))
            del edge[f]
            touch[b] = [e if t == f else t for t in touch[b]]
        bridged = bool(pdf["bridged"].iloc[0])
        return pd.DataFrame([(e, u, v, d, [{"x": x, "y": y} for x, y in _points(line)], bridged) for e, (u, v, d, line) in edge.items()], columns=["eid", "u", "v", "length", "line", "bridged"])

    merged = rows.groupBy("chain").applyInPandas(follow, _EDGE)
    return edges.join(groups, "eid", "left_anti").unionByName(merged)


def _turned(line: tuple, turn: bool) -> tuple:
    return line[0], line[1] != turn


def _points(line: tuple) -> list:
    """The points of a tree of pieces in order; a piece leaves out its first point, where the one before it has ended."""
    out: list = []
    todo = [line]
    while todo:
        content, back = todo.pop()
        if isinstance(content, tuple):
            parts = [_turned(x, back) for x in (content[::-1] if back else content)]
            todo += parts[::-1]
        else:
            piece = content[::-1] if back else content
            out += piece[1:] if out else piece
    return out


def major_parts(edges: DataFrame, min_km: float) -> DataFrame:
    """(id): nodes of the parts with min_km of edges at least; if there is none, of the longest part."""
    parts = materialise(components(edges.select("u", "v")), "major-parts")
    size = edges.join(parts.withColumnRenamed("v", "u"), "u").groupBy("comp").agg(F.sum("length").alias("total"))
    top = size.agg(F.max(F.struct("total", (-F.col("comp")).alias("m"), "comp")).getField("comp").alias("top"), F.max("total").alias("most"))
    keep = size.crossJoin(F.broadcast(top)).where((F.col("total") >= min_km * 1000) | ((F.col("most") < min_km * 1000) & (F.col("comp") == F.col("top"))))  # top is one row
    return parts.join(keep.select("comp"), "comp", "left_semi").select(F.col("v").alias("id"))


def relabelled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered 0, 1, ... in the order of their ids, and the edges whose ends both remain.

    Numbers come from a count of the rows ahead by partition of a range sort, not from one sorted partition."""
    numbered = dense_ids(nodes.select("id"), "id", "new")
    new_nodes = nodes.join(numbered, "id").select(F.col("new").alias("id"), *(c for c in nodes.columns if c != "id"))
    to = lambda c: numbered.select(F.col("id").alias(c), F.col("new").alias(f"{c}_new"))
    kept = edges.join(to("u"), "u").join(to("v"), "v").withColumn("u", F.col("u_new")).withColumn("v", F.col("v_new"))
    return new_nodes, kept.select(*edges.columns)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with 0, 1, ... in the order of its distinct key."""
    placed = materialise(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "ids-placed")
    ahead = placed.groupBy("_part").agg(F.count("*").alias("n"))
    ahead = ahead.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_ahead"))  # a row per partition
    local = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return placed.withColumn("_local", local).join(F.broadcast(ahead), "_part").withColumn(name, (F.col("_ahead") + F.col("_local")).cast("long")).drop("_part", "_local", "_ahead")


def peel_new(edges: DataFrame, first_new: int) -> DataFrame:
    """Drop edges at added nodes (id >= first_new) of degree 1, again and again."""
    edges = materialise(edges, "peel")
    while True:
        ends = degrees(edges).where((F.col("degree") <= 1) & (F.col("id") >= first_new)).select("id")
        gone = materialise(edges.select("eid", F.explode(F.array("u", "v")).alias("id")).join(ends, "id", "left_semi").select("eid").distinct(), "peel-gone")
        if gone.isEmpty():
            return edges
        edges = replace(edges, edges.join(gone, "eid", "left_anti"), "peel")
