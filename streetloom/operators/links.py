"""Joining disconnected parts of a street graph by mapped roads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MAJOR_ROADS, LinkParams
from ..functions import lines as L
from ..functions.text import direction, first_filled
from ..tables import materialise, unbroadcast
from .components import strong_part
from .grid import in_cells, in_near_cells, nearest
from .roads import dense_ids, peel_new, relabelled


def way_pieces(ways: DataFrame) -> DataFrame:
    """ways (way_id, tags, nodes, line) cut at nodes used more than once anywhere: way_id, piece, a, b, line, name, dir.

    A way that is driven against its order is turned first. The cut node belongs to both pieces."""
    turned = ways.withColumn("dir", direction(F.col("tags")))
    back = F.col("dir") < 0
    turned = turned.select("way_id", "dir", first_filled(F.col("tags")["name"], F.col("tags")["ref"]).alias("name"), F.when(back, F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"), F.when(back, F.reverse("line")).otherwise(F.col("line")).alias("line"))
    rows = turned.select("way_id", "dir", "name", F.size("nodes").alias("n"), F.posexplode(F.arrays_zip("nodes", "line")).alias("pos", "at")).select("way_id", "dir", "name", "n", "pos", F.col("at.nodes").alias("node"), F.col("at.line").alias("p"))
    used = rows.groupBy("node").agg(F.count("*").alias("uses"))
    order = W.partitionBy("way_id").orderBy("pos")  # a way's own nodes: a few thousand at most by the data's own rules
    cut = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1) | (F.col("uses") > 1)
    marked = rows.join(unbroadcast(used), "node").withColumn("cut", cut).withColumn("piece", F.sum(F.col("cut").cast("int")).over(order) - F.col("cut").cast("int"))
    # A cut node ends the piece before it and begins the next.
    starts = marked.where("cut and pos < n - 1").withColumn("piece", F.col("piece") + 1)
    both = marked.where("pos > 0").unionByName(starts)
    points = F.array_sort(F.collect_list(F.struct("pos", "node", "p")))
    out = both.groupBy("way_id", "dir", "name", "piece").agg(points.alias("points")).where(F.size("points") >= 2)
    return out.select("way_id", (F.col("piece") - 1).alias("piece"), F.col("points")[0]["node"].alias("a"), F.element_at("points", -1)["node"].alias("b"), F.transform("points", lambda x: x["p"]).alias("line"), "name", F.when(F.col("dir") < 0, 1).otherwise(F.col("dir")).alias("dir"))


def coverage(pieces: DataFrame, edges: DataFrame, p: LinkParams = LinkParams(), key: str = "pid") -> DataFrame:
    """(key, share): the share of each piece's points, every step_m, within cover_m of such a point of any edge."""
    own = L.densified(pieces, key, p.step_m).select(key, "seg", "k", "x", "y")
    there = in_cells(L.densified(edges, "eid", p.step_m).select("x", "y"), p.cover_m).select("cx", "cy", F.col("x").alias("ex"), F.col("y").alias("ey"))
    near = in_near_cells(own, p.cover_m).join(unbroadcast(there), ["cx", "cy"]).where(L.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey")) <= p.cover_m)
    hit = near.select(key, "seg", "k").distinct().withColumn("hit", F.lit(1))
    return own.join(hit, [key, "seg", "k"], "left").groupBy(key).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def attach_ends(ends: DataFrame, nodes: DataFrame, p: LinkParams = LinkParams()) -> DataFrame:
    """Ends (osm, x, y) -> osm, action (snap, connect or new), id (of the nearest original node, where it counts), distance."""
    near = nearest(ends.dropDuplicates(["osm"]), nodes.select("id", "x", "y"), p.connect_m, "osm", "id")
    action = F.when(F.col("distance") <= p.snap_m, "snap").when(F.col("distance") <= p.connect_m, "connect").otherwise("new")
    return near.withColumn("action", action).withColumn("id", F.when(action != "new", F.col("id")))


def connect(nodes: DataFrame, edges: DataFrame, ways: DataFrame, p: LinkParams = LinkParams()) -> tuple[DataFrame, DataFrame]:
    """Add mapped roads to a graph and keep the part that is strongly connected: new nodes (id, x, y) and edges.

    edges: eid, u, v, length, line, bridged, oneway, name. Pieces of major roads that the streets don't cover already become
    edges (linked true); an end within snap_m of a node becomes it, within connect_m it gets a straight connector (bridged),
    else it stands alone. Added dead ends are peeled off, the largest strong component stays, and ids are dense again."""
    major = ways.where(F.coalesce(F.col("tags")["highway"], F.lit("")).isin(*MAJOR_ROADS))
    pieces = materialise(dense_ids(way_pieces(major).withColumn("k", F.struct("way_id", "piece")), "k", "pid").drop("k"), "link-pieces")
    pieces = pieces.where(L.length(F.col("line")) > 0)
    covered = coverage(pieces, edges, p).where(F.col("share") >= p.cover_share).select("pid")
    fresh = materialise(pieces.join(covered, "pid", "left_anti"), "link-fresh")
    first, last = F.col("line")[0], F.element_at("line", -1)
    ends = fresh.select(F.col("a").alias("osm"), first["x"].alias("x"), first["y"].alias("y")).union(fresh.select("b", last["x"], last["y"])).groupBy("osm").agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y"))
    at = materialise(attach_ends(ends, nodes, p), "link-ends")
    top = nodes.agg((F.max("id") + 1).alias("first")).first().first or 0
    made = materialise(dense_ids(at.where("action <> 'snap'").select("osm", "x", "y", "action", F.col("id").alias("to"), "distance"), "osm", "k").withColumn("id", F.col("k") + top).drop("k"), "link-made")
    place = at.where("action = 'snap'").select("osm", "id").union(made.select("osm", "id"))
    to = lambda c, n: place.select(F.col("osm").alias(c), F.col("id").alias(n))
    added = fresh.join(to("a", "u"), "a").join(to("b", "v"), "b").where("u <> v")
    last_id = edges.agg((F.max("eid") + 1).alias("first")).first().first or 0
    roads = added.select((F.col("pid") + last_id).alias("eid"), "u", "v", L.length(F.col("line")).alias("length"), "line", F.lit(False).alias("bridged"), (F.col("dir") != 0).alias("oneway"), "name", F.lit(True).alias("linked"))
    target = nodes.select(F.col("id").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    straight = F.array(F.struct("x", "y"), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")))
    base = last_id + (pieces.agg(F.max("pid")).first()[0] or 0) + 1
    ties = made.where("action = 'connect'").join(target, "to").select((F.col("id") - top + base).alias("eid"), F.col("id").alias("u"), F.col("to").alias("v"), F.col("distance").alias("length"), straight.alias("line"), F.lit(True).alias("bridged"), F.lit(False).alias("oneway"), F.lit("").alias("name"), F.lit(True).alias("linked"))
    everything = edges.withColumn("linked", F.lit(False)).unionByName(roads).unionByName(ties)
    peeled = peel_new(everything, top)
    all_nodes = materialise(nodes.select("id", "x", "y").union(made.select("id", "x", "y")), "link-nodes")
    strong = strong_part(peeled, all_nodes.select(F.col("id").alias("v"))).withColumnRenamed("v", "id")
    return relabelled(all_nodes.join(strong, "id", "left_semi"), peeled)
