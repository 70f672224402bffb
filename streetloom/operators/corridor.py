"""From block faces to a skeleton of pixels, and from pixels to nodes and edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CorridorParams
from ..functions import lines as L
from ..kernels import raster
from ..tables import materialise
from .components import components
from .grid import cell


def georeference(faces: DataFrame, p: CorridorParams) -> DataFrame:
    """One row: x0, y0 (top left corner), width and height in pixels, with a pad of four half widths around the lines."""
    pad = 4 * p.half_width_m
    points = faces.select(F.explode("line").alias("q"))
    ends = points.agg(F.min("q.x").alias("x0"), F.max("q.x").alias("x1"), F.min("q.y").alias("y0"), F.max("q.y").alias("y1"))
    pixels = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo) + 2 * pad) / p.resolution_m).cast("long")
    return ends.select((F.col("x0") - pad).alias("x0"), (F.col("y1") + pad).alias("y0"), pixels("x0", "x1").alias("width"), pixels("y0", "y1").alias("height"))


def skeleton(faces: DataFrame, p: CorridorParams = CorridorParams(), upto: str = "thin") -> tuple[DataFrame, DataFrame]:
    """faces (face_id, line in metres) -> keys (key = row * width + column) of the thinned corridors, and the georeference.

    The image is worked on in tiles of tile_m with a margin around each, of which only the core counts; a segment goes to
    every tile whose margin its corridor touches. A task holds one tile, whatever the size of the area. `upto` ends the
    work earlier: burn (the corridors as drawn), close, fill or thin."""
    steps = ("burn", "close", "fill", "thin")[: ("burn", "close", "fill", "thin").index(upto) + 1]
    geo = materialise(georeference(faces, p), "skeleton-geo")
    segs = L.segments(faces.select("face_id", "line"), "face_id")
    last = faces.select("face_id", (F.size("line") - 2).alias("last"))
    rows = segs.join(last, "face_id").select("ax", "ay", "bx", "by", (F.col("seg") < F.col("last")).alias("joint")).crossJoin(F.broadcast(geo))  # geo is one row
    core = max(1, int(round(p.tile_m / p.resolution_m)))
    margin = int(np.ceil(p.tile_margin_m / p.resolution_m))
    reach = p.half_width_m + p.tile_margin_m + 2 * p.resolution_m
    size = core * p.resolution_m
    across = lambda a, b, o: F.sequence(F.greatest(cell(F.least(a, b) - o - reach, size), F.lit(0)), F.greatest(cell(F.greatest(a, b) - o + reach, size), F.lit(0)))
    tiles = rows.withColumn("tc", F.explode(across(F.col("ax"), F.col("bx"), F.col("x0"))))
    tiles = tiles.withColumn("tr", F.explode(across(-F.col("ay"), -F.col("by"), -F.col("y0"))))
    inside = (F.col("tc") * core < F.col("width")) & (F.col("tr") * core < F.col("height"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        width, height, tr, tc = int(one["width"]), int(one["height"]), int(one["tr"]), int(one["tc"])
        r0, c0 = max(0, tr * core - margin), max(0, tc * core - margin)
        r1, c1 = min(height, (tr + 1) * core + margin), min(width, (tc + 1) * core + margin)
        segments = pdf[["ax", "ay", "bx", "by"]].to_numpy()
        joints = pdf.loc[pdf["joint"], ["bx", "by"]].to_numpy()
        mask = raster.burn(segments, joints, one["x0"] + c0 * p.resolution_m, one["y0"] - r0 * p.resolution_m, (r1 - r0, c1 - c0), p.resolution_m, p.half_width_m)
        mask = raster.close(mask, p.close_iterations) if "close" in steps else mask
        mask = raster.fill_holes(mask, p.hole_pixels) if "fill" in steps else mask
        mask = raster.thin(mask) if "thin" in steps else mask
        a, b = tr * core - r0, tc * core - c0
        kept = mask[a : a + min(core, height - tr * core), b : b + min(core, width - tc * core)]
        return pd.DataFrame({"key": raster.skeleton_keys(kept, tr * core, tc * core, width)})

    columns = ["tr", "tc", "ax", "ay", "bx", "by", "joint", "x0", "y0", "width", "height"]
    return tiles.where(inside).select(*columns).groupBy("tr", "tc").applyInPandas(work, "key long").distinct(), geo


def neighbours(keys: DataFrame, width: int) -> DataFrame:
    """(key, other): the 8-neighbours among keys; columns are checked, so nothing wraps round the image's edge."""
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
    moves = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))).alias("m")
    column = F.pmod(F.col("key"), F.lit(width))
    other = keys.select("key", moves).where((column + F.col("m.c")).between(0, width - 1)).select("key", (F.col("key") + F.col("m.r") * width + F.col("m.c")).alias("other"))
    return other.join(keys.select(F.col("key").alias("other")), "other", "left_semi").select("key", "other")


def pixel_graph(keys: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, row, col) and edges (eid, u, v, path) of a one-pixel-wide skeleton.

    Pixels whose number of neighbours is not two are nodes, 8-connected ones together, at their middle; a ring without any
    takes its lowest pixel. Each maximal chain of other pixels between nodes is an edge, whose path holds both end pixels;
    a single pixel that leads back to one node is none. Nodes are numbered by their lowest pixel."""
    keys = materialise(keys.select("key").distinct(), "pixels")
    near = materialise(neighbours(keys, width), "pixel-neighbours")
    degree = keys.join(near.groupBy("key").agg(F.count("*").alias("n")), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts = components(near.select(F.col("key").alias("u"), F.col("other").alias("v")), keys.withColumnRenamed("key", "v"))
    marked = materialise(degree.withColumn("node", F.col("n") != 2).join(parts.withColumnRenamed("v", "key"), "key"), "pixel-marked")
    rings = marked.groupBy("comp").agg(F.max("node").alias("any"), F.min("key").alias("key")).where("not any").select("key", F.lit(True).alias("ring"))
    marked = materialise(marked.join(rings, "key", "left").select("key", (F.col("node") | F.coalesce("ring", F.lit(False))).alias("node")), "pixel-nodes")
    is_node, inner = marked.where("node").select("key"), marked.where("not node").select("key")
    both = near.join(is_node, "key", "left_semi").join(is_node.withColumnRenamed("key", "other"), "other", "left_semi")
    blobs = materialise(components(both.select(F.col("key").alias("u"), F.col("other").alias("v")), is_node.withColumnRenamed("key", "v")).withColumnsRenamed({"v": "key", "comp": "blob"}), "pixel-blobs")
    row, col = F.floor(F.col("key") / width), F.pmod(F.col("key"), F.lit(width))
    nodes = blobs.groupBy("blob").agg(F.avg(row).alias("row"), F.avg(col).alias("col")).withColumnRenamed("blob", "id")

    joined = near.join(inner, "key", "left_semi").join(inner.withColumnRenamed("key", "other"), "other", "left_semi")
    chains = materialise(components(joined.select(F.col("key").alias("u"), F.col("other").alias("v")), inner.withColumnRenamed("key", "v")).withColumnsRenamed({"v": "key", "comp": "chain"}), "pixel-chains")
    # Each chain with its pixels' links, to each other and to node pixels.
    links = chains.join(near, "key").join(blobs.withColumnsRenamed({"key": "other"}), "other", "left").select("chain", "key", "other", "blob")

    def trace_all(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [trace(own) for _, own in pdf.groupby("chain")]
        return pd.concat(found, ignore_index=True)

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        near_: dict[int, list[int]] = {}
        blob: dict[int, int] = {}
        for k, o, b in zip(pdf["key"], pdf["other"], pdf["blob"], strict=True):
            near_.setdefault(int(k), []).append(int(o))
            if not pd.isna(b):
                blob[int(o)] = int(b)
        # A chain pixel has two neighbours; the ends are those beside a node pixel.
        start = min((o, k) for k, others in near_.items() for o in others if o in blob)
        path, before, at = [start[0]], start[0], start[1]
        while at not in blob:
            path.append(at)
            ahead = [o for o in near_[at] if o != before] or [before]
            before, at = at, min(ahead)
        path.append(at)
        u, v = blob[path[0]], blob[path[-1]]
        if len(path) == 3 and u == v:
            return pd.DataFrame({"eid": [], "u": [], "v": [], "path": []})
        return pd.DataFrame({"eid": [chain], "u": [u], "v": [v], "path": [path]})

    # Lists of pixel numbers pass as blobs of doubles where a null is among them; ids stay below 2**53.
    # Chains are short and many, so a call gets those of a hash bucket; the number of buckets follows the number of pixels.
    buckets = max(1, keys.count() // 20_000)
    dealt = links.withColumn("bucket", F.pmod(F.xxhash64("chain"), F.lit(buckets)))
    edges = dealt.groupBy("bucket").applyInPandas(trace_all, "eid long, u long, v long, path array<long>")
    return nodes, edges


def street_graph(nodes: DataFrame, edges: DataFrame, geo: DataFrame, p: CorridorParams) -> tuple[DataFrame, DataFrame]:
    """Pixel nodes and edges in metres: nodes (id, x, y), edges (eid, u, v, length, line, bridged); zero lengths go."""
    x = lambda c, g: g["x0"] + (c + 0.5) * p.resolution_m
    y = lambda r, g: g["y0"] - (r + 0.5) * p.resolution_m
    g = {k: F.col(k) for k in ("x0", "y0", "width")}
    metres = nodes.crossJoin(F.broadcast(geo)).select("id", x(F.col("col"), g).alias("x"), y(F.col("row"), g).alias("y"))  # geo is one row
    point = lambda k: F.struct(x(F.pmod(k, g["width"]), g).cast("double").alias("x"), y(F.floor(k / g["width"]), g).cast("double").alias("y"))
    lines = edges.crossJoin(F.broadcast(geo)).select("eid", "u", "v", F.transform("path", point).alias("line"))  # geo is one row
    return metres, lines.select("eid", "u", "v", L.length(F.col("line")).alias("length"), "line", F.lit(False).alias("bridged")).where("length > 0")
