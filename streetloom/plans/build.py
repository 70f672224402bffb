"""Stages put together: block faces to a street graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CorridorParams
from ..functions import lines as L
from ..kernels.paths import simplify
from ..operators import corridor, roads
from ..operators.detours import link_detours
from ..operators.grid import nearest_segment
from ..tables import materialise


def simplified(line, tolerance: float):
    """Lines with fewer vertices, none further than tolerance from the original."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: [{"x": x, "y": y} for x, y in simplify([(p["x"], p["y"]) for p in line], tolerance)])

    return run(line)


def name_edges(edges: DataFrame, faces: DataFrame, start: float = 64.0) -> DataFrame:
    """edges and name: that of the face nearest to the middle of the line; estimated links have an empty one.

    The distance is that to the face's line, of which each segment is a target; ties go to the smaller face_id."""
    middle = L.middles(edges.where("not bridged"), "eid")
    found = nearest_segment(middle, L.segments(faces, "face_id"), start, "eid", "face_id").select("eid", "face_id")
    named = found.join(faces.select("face_id", "name"), "face_id").select("eid", "name")
    return edges.join(named, "eid", "left").withColumn("name", F.coalesce("name", F.lit("")))


def build_graph(faces: DataFrame, p: CorridorParams = CorridorParams(), stages=None) -> tuple[DataFrame, DataFrame]:
    """faces (face_id, name, line in metres) -> nodes (id, x, y) and edges (eid, u, v, length, line, bridged, name).

    stages, if given, gets a lap after each stage."""
    lap = stages.lap if stages else lambda stage: None
    faces = materialise(faces.select("face_id", "name", "line"), "build-faces")
    keys, geo = corridor.skeleton(faces, p)
    width = geo.first().width
    if width is None:
        raise ValueError("there are no faces to build a graph from")
    lap("skeleton")
    nodes, edges = corridor.street_graph(*corridor.pixel_graph(keys, int(width)), geo, p)
    lap("pixel graph")
    pruned = roads.prune_spurs(edges, p.min_spur_m)
    # Nodes go with their last spur, but the node of an isolated ring stays when its loop is dropped, and may be linked.
    nodes, edges = materialise(roads.without_isolated(nodes, pruned), "build-nodes"), materialise(roads.without_loops(pruned), "build-edges")
    nodes, edges = roads.merge_junctions(nodes, edges, 1.5 * p.half_width_m)
    nodes, edges = materialise(nodes, "build-nodes"), materialise(edges, "build-edges")
    lap("spurs and junctions")
    edges = _with_links(nodes, edges, roads.link_components(nodes, edges, p.max_gap_m, p.neighbours))
    edges = materialise(roads.contract_chains(edges), "build-edges")
    nodes = materialise(roads.without_isolated(nodes, edges), "build-nodes")
    lap("parts and chains")
    barriers = L.segments(faces, "face_id")
    edges = _with_links(nodes, edges, link_detours(nodes, edges, barriers, p.detour_gap_m, p.max_detour))
    lap("detours")
    keep = roads.major_parts(edges, p.min_component_km)
    edges = edges.withColumn("line", simplified(F.col("line"), p.simplify_m))
    edges = name_edges(materialise(edges, "build-edges"), faces)
    return roads.relabelled(nodes.join(keep, "id", "left_semi"), edges)


def _with_links(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges and straight, estimated ones behind them."""
    last = edges.agg(F.coalesce(F.max("eid") + 1, F.lit(0)).alias("n")).first().n
    at = lambda c: nodes.select(F.col("id").alias(c), F.struct("x", "y").alias(f"{c}p"))
    numbered = roads.dense_ids(links.withColumn("k", F.struct("length", "u", "v")), "k", "n").drop("k")
    new = numbered.join(at("u"), "u").join(at("v"), "v").select((F.col("n") + last).alias("eid"), "u", "v", "length", F.array("up", "vp").alias("line"), F.lit(True).alias("bridged"))
    return materialise(edges.unionByName(new), "build-edges")
