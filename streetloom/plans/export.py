"""From files to published documents, and their later enrichment: what the command line runs.

A publication is a folder: places.json, states.geojson, municipalities/<state>.geojson, neighbourhoods/<area>.geojson and
graph/<area>.json. Areas are worked on one after the other and places.json is written after each, so a long run can be
stopped and taken up again.
"""

from __future__ import annotations

import json
import logging
import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CorridorParams, LinkParams, MatchParams
from ..functions import lines as L
from ..functions import projection as P
from ..operators import links, oneway
from ..sinks import documents as sink
from ..sources import documents as source
from ..sources import fetch
from ..sources.areas import Area
from ..sources.shapes import face_table, zipped_shapes
from ..tables import materialise
from .build import build_graph

LOG = logging.getLogger("streetloom")
SOURCE = "block faces: corridors, skeleton, graph"
DIRECTION_SOURCE = "OpenStreetMap one-way tags matched to the edges; © OpenStreetMap contributors (ODbL)"
LINK_SOURCE = "OpenStreetMap roads that join separate parts; © OpenStreetMap contributors (ODbL)"


class Stages:
    """How long each stage took, with counts: log lines, and the rows of `table`."""

    def __init__(self) -> None:
        self.began, self.rows = time.perf_counter(), []

    def lap(self, stage: str, **counts: float) -> None:
        now = time.perf_counter()
        self.rows.append((len(self.rows), stage, now - self.began, {k: float(v) for k, v in counts.items()}))
        LOG.info("%-20s %7.1f s %s", stage, now - self.began, ", ".join(f"{k} {v:g}" for k, v in counts.items()))
        self.began = now

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "n int, stage string, seconds double, counts map<string,double>")


@dataclass(frozen=True)
class Cache:
    """Where the downloaded files lie below a uri."""

    uri: str

    def faces(self, uf: str) -> str:
        return f"{self.uri}/{uf}_faces.zip"

    def neighbourhoods(self, uf: str) -> str:
        return f"{self.uri}/{uf}_neighbourhoods.zip"

    def document(self, name: str) -> str:
        return f"{self.uri}/{name}"


def totals(edges: DataFrame, *by: str) -> DataFrame:
    """Numbers and kilometres of edges (length, bridged and others), in all and of estimated links, by class if asked for."""
    links_ = F.col("bridged")
    km = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("length"))), F.lit(0.0)) / 1000
    return edges.groupBy(*by).agg(F.count("*").alias("edges"), (F.coalesce(F.sum("length"), F.lit(0.0)) / 1000).alias("km"), F.count_if(links_).alias("links"), km(links_).alias("links_km"))


def boundaries(spark: SparkSession, cache: Cache, out: str) -> tuple[DataFrame, DataFrame]:
    """Write the boundary documents; returns states (code, uf, name, bbox) and municipalities (code, uf, state, name, bbox).

    A state must be known by name; a municipality without one is named by its number."""
    states = source.places(spark, cache.document("states.json")).select(F.col("id").alias("state"), F.col("sigla").alias("uf"), F.col("nome"))
    shapes = source.named_boundaries(source.boundaries(spark, cache.document("states.geojson")), states.select(F.col("state").alias("id"), "nome"), keep_unknown=False)
    shapes = materialise(shapes.join(states.select(F.col("state").alias("code"), "uf"), "code").withColumn("all", F.lit("states.geojson")), "states")
    sink.write_documents(sink.collection_texts(shapes, "all", "code", "code", "uf", "name"), out, "all")
    names = source.places(spark, cache.document("municipalities_*.json"))
    parts = source.boundaries(spark, cache.document("municipalities_*.geojson"), with_path=True)
    parts = source.named_boundaries(parts, names, keep_unknown=True).withColumn("state", F.regexp_extract("path", r"municipalities_(\d+)[.]geojson$", 1).cast("long"))
    parts = materialise(parts.withColumn("file", F.concat(F.lit("municipalities/"), F.col("state").cast("string"), F.lit(".geojson"))), "municipalities")
    sink.write_documents(sink.collection_texts(parts, "file", "code", "code", "name"), out, "file")
    box = sink.geometry_box(F.col("coordinates")).alias("bbox")
    return shapes.select("code", "uf", "name", box), parts.join(states.select("state", "uf"), "state").select("code", "uf", "state", "name", box)


def neighbourhoods(spark: SparkSession, cache: Cache, area: Area, out: str) -> DataFrame:
    """Write an area's neighbourhoods, if there are any; returns entries (code, name, municipality, area, bbox)."""
    found = None
    for m in area.municipalities:
        own = source.neighbourhoods(spark, cache.neighbourhoods(area.uf), m).withColumn("municipality", F.lit(m))
        found = own if found is None else found.unionByName(own)
    rings = found.groupBy("code", "name", "municipality").agg(F.to_json(F.array(F.transform(F.first("line"), lambda p: F.array(p["x"], p["y"])))).alias("coordinates"))
    rows = materialise(rings.withColumns({"kind": F.lit("Polygon"), "file": F.lit(f"neighbourhoods/{area.id}.geojson")}), "neighbourhoods")
    sink.write_documents(sink.collection_texts(rows, "file", "code", "code", "name"), out, "file")
    return rows.select("code", "name", "municipality", F.lit(area.id).alias("area"), sink.geometry_box(F.col("coordinates")).alias("bbox"))


def faces_of(spark: SparkSession, cache: Cache, area: Area) -> DataFrame:
    """The block faces of all members of an area: one network across their borders."""
    from ..sources.areas import union

    return union([face_table(zipped_shapes(spark, cache.faces(area.uf), f"{area.uf}/{m}_")) for m in area.municipalities])


def _lonlat(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))


def build_area(spark: SparkSession, area: Area, faces: DataFrame, out: str, p: CorridorParams = CorridorParams(), stages: Stages | None = None) -> dict:
    """faces (face_id, name, line in degrees as x, y) -> the area's graph document, and its entry in places.json."""
    stages = stages or Stages()
    zone = int(P.zone_of_table(faces.select(F.explode("line").alias("q")).select(F.col("q.x").alias("lon"))).first().zone)
    metres = faces.withColumn("line", P.project_line(_lonlat(F.col("line")), F.lit(zone)))
    nodes, edges = build_graph(metres, p, stages)
    lon, lat = P.inverse(F.col("x"), F.col("y"), F.lit(zone))
    nodes = materialise(nodes.select("id", lon.alias("lon"), lat.alias("lat")), "area-nodes")
    edges = materialise(_dense(edges.withColumn("line", P.unproject_line(F.col("line"), F.lit(zone)))), "area-edges")
    payload = sink.graph_payload(nodes, edges, area.id, area.name, list(area.municipalities), SOURCE, f"EPSG:{P.EPSG_SOUTH + zone}", {k: float(v) for k, v in asdict(p).items()})
    entry = publish(spark, area.id, payload, out) | {"name": area.name, "municipalities": list(area.municipalities)}
    t = totals(edges).first()
    stages.lap(f"written {area.name}", nodes=nodes.count(), edges=t.edges, km=t.km, links=t.links, links_km=t.links_km, chars=entry["bytes"])
    return entry


def _dense(edges: DataFrame) -> DataFrame:
    from ..operators.roads import dense_ids

    return dense_ids(edges, "eid", "new_eid").drop("eid").withColumnRenamed("new_eid", "eid")


def publish(spark: SparkSession, area_id: str, payload: DataFrame, out: str) -> dict:
    """Write a graph document; its box and its number of characters."""
    written = sink.write_documents(payload.select(F.lit(f"graph/{area_id}.json").alias("file"), F.col("payload").alias("json")), out, "file").first()
    box = sink.payload_box(source.payload(spark, f"{out}/graph/{area_id}.json")).first()
    return {"id": area_id, "bbox": list(box.bbox) if box else [], "bytes": written.chars}


def read_places(spark: SparkSession, out: str) -> dict:
    path = f"{out}/places.json"
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if fetch.exists(path) else {}


def write_places(out: str, places: dict) -> None:
    """A small document of some thousand entries, written by the driver."""
    fetch.write_bytes(f"{out}/places.json", json.dumps(places, ensure_ascii=False, separators=(",", ":")).encode())


def merged(old: list[dict], new: list[dict], catalogue: tuple[Area, ...]) -> list[dict]:
    """Entries of areas: those built now and the others as they were, in catalogue order."""
    by_id = {r["id"]: r for r in old} | {r["id"]: r for r in new}
    return [by_id[a.id] for a in catalogue if a.id in by_id]


def export(spark: SparkSession, cache: Cache, out: str, areas: list[Area], catalogue: tuple[Area, ...], p: CorridorParams = CorridorParams()) -> dict:
    """Boundaries, neighbourhoods and graphs of the areas; what other areas have published before stays."""
    old = read_places(spark, out)
    rebuilt, routed = {a.id for a in areas}, [r for r in old.get("routed", []) if r["id"] not in {a.id for a in areas}]
    known = {r["id"] for r in routed}
    local = [b for b in old.get("neighbourhoods", []) if b["area"] in known - rebuilt]
    states, municipalities = ([r.asDict() for r in t.orderBy("code").collect()] for t in boundaries(spark, cache, out))
    places = {"states": states, "municipalities": municipalities}
    for area in areas:
        local += [r.asDict() for r in neighbourhoods(spark, cache, area, out).orderBy("code").collect()]
        routed.append(build_area(spark, area, faces_of(spark, cache, area), out, p))
        places |= {"neighbourhoods": local, "routed": merged(routed, [], catalogue)}
        write_places(out, places)
    return places


def _tables(payloads: DataFrame, zone: int) -> tuple[DataFrame, DataFrame]:
    """A payload's nodes (id, lon, lat, x, y) and edges in metres, with the line in degrees as `degrees`."""
    x, y = P.forward(F.col("lon"), F.col("lat"), F.lit(zone))
    nodes = source.payload_nodes(payloads).select("id", "lon", "lat", x.alias("x"), y.alias("y"))
    edges = source.payload_edges(payloads).withColumn("degrees", F.col("line")).withColumn("line", P.project_line(F.col("line"), F.lit(zone)))
    return materialise(nodes, "payload-nodes"), materialise(edges.drop("path"), "payload-edges")


def _rewritten(spark: SparkSession, area_id: str, head, nodes: DataFrame, edges: DataFrame, out: str, notes: dict[str, str]) -> dict:
    payload = sink.graph_payload(nodes, edges, head.municipality.code, head.municipality.name, list(head.municipalities), head.source, head.crs, dict(head.params), notes)
    return publish(spark, area_id, payload, out)


def add_directions(spark: SparkSession, area_id: str, ways: DataFrame, out: str, p: MatchParams = MatchParams()) -> tuple[dict, DataFrame]:
    """Give the area's document driving directions from one-way ways (way_id, coords in degrees, in driving order).

    Edges that keep a direction run along it, in their ends and their line; directionSource names the origin. A second run
    gives the same document. Returns the new entry and the row of oneway_summary."""
    payloads = source.payload(spark, f"{out}/graph/{area_id}.json")
    head = payloads.select("municipality", "municipalities", "source", "crs", "params", "linkSource").first()
    zone = int(head.crs.rpartition(":")[2]) - P.EPSG_SOUTH
    nodes, edges = _tables(payloads, zone)
    lines = ways.select("way_id", P.project_line(F.col("coords"), F.lit(zone)).alias("line"))
    at = nodes.select(F.col("id").alias("u"), "x", "y")
    facing = edges.join(at, "u").withColumn("line", L.oriented(F.col("line"), F.col("x"), F.col("y"))).drop("x", "y", "oneway")
    driven = materialise(oneway.assign_oneway(facing, lines, p), "payload-driven")
    # A document's line is turned only for kept directions, if its last point is the one closer to the new first node.
    start = nodes.select(F.col("id").alias("u"), F.col("lon").alias("ulon"), F.col("lat").alias("ulat"))
    gap = lambda q: L.distance(q["lon"], q["lat"], F.col("ulon"), F.col("ulat"))
    turned = F.col("oneway") & (gap(F.col("degrees")[0]) > gap(F.element_at("degrees", -1)))
    new = driven.join(start, "u").withColumn("line", F.when(turned, F.reverse("degrees")).otherwise(F.col("degrees")))
    notes = {"directionSource": DIRECTION_SOURCE} | ({"linkSource": head.linkSource} if head.linkSource else {})
    entry = _rewritten(spark, area_id, head, nodes, materialise(new.drop("ulon", "ulat", "degrees"), "payload-new"), out, notes)
    return entry, oneway.oneway_summary(oneway.match_directions(facing, lines, p), driven)


def add_links(spark: SparkSession, area_id: str, ways: DataFrame, out: str, p: LinkParams = LinkParams()) -> tuple[dict, DataFrame]:
    """Join the parts of the area's document by mapped roads (way_id, tags, nodes, coords in degrees).

    Only the largest part in which all can reach all stays; linkSource names the origin. Returns the new entry and totals
    by class (street, road, connector) before and after."""
    payloads = source.payload(spark, f"{out}/graph/{area_id}.json")
    head = payloads.select("municipality", "municipalities", "source", "crs", "params", "directionSource").first()
    zone = int(head.crs.rpartition(":")[2]) - P.EPSG_SOUTH
    nodes, edges = _tables(payloads, zone)
    roads = ways.select("way_id", "tags", "nodes", P.project_line(F.col("coords"), F.lit(zone)).alias("line"))
    new_nodes, new_edges = links.connect(nodes.select("id", "x", "y"), edges.drop("degrees"), roads, p)
    new_nodes, new_edges = materialise(new_nodes, "linked-nodes"), materialise(new_edges, "linked-edges")
    lon, lat = P.inverse(F.col("x"), F.col("y"), F.lit(zone))
    kept = new_edges.join(edges.select("eid", "degrees"), "eid", "left").withColumn("line", F.coalesce("degrees", P.unproject_line(F.col("line"), F.lit(zone)))).drop("degrees")
    notes = ({"directionSource": head.directionSource} if head.directionSource else {}) | {"linkSource": LINK_SOURCE}
    entry = _rewritten(spark, area_id, head, new_nodes.select("id", lon.alias("lon"), lat.alias("lat")), materialise(_dense(kept), "linked-new"), out, notes)
    kind = F.when(~F.col("linked"), "street").when(F.col("bridged"), "connector").otherwise("road")
    both = edges.select(F.lit("before").alias("at"), F.lit("street").alias("kind"), "length", "bridged").unionByName(new_edges.select(F.lit("after").alias("at"), kind.alias("kind"), "length", "bridged"))
    return entry, totals(both, "at", "kind")


def enrich(spark: SparkSession, out: str, areas: list[Area], tiles: str, kind: str, service: str | None = None, **how) -> dict:
    """Directions (kind "oneway") or links (kind "links") for published areas, from cached map tiles; places.json follows.

    Each area's box is cut into tiles, which are fetched into `tiles` if a service is named and they are not there."""
    places = read_places(spark, out)
    boxes = {r["id"]: tuple(r["bbox"]) for r in places.get("routed", [])}
    for area in areas:
        if area.id not in boxes:
            raise KeyError(f"area {area.id!r} has not been published; published are {', '.join(sorted(boxes))}")
        query = fetch.oneway_query if kind == "oneway" else fetch.roads_query
        paths = []
        for box in source.tile_boxes(*boxes[area.id]):
            path = fetch.tile_path(tiles, f"{area.id}/{kind}", box)
            paths.append(fetch.fetch_tile(service, query(box), path, **how) if service else path)
        elements = source.map_elements(spark, paths)
        if kind == "oneway":
            entry, counts = add_directions(spark, area.id, source.oneway_ways(elements), out)
        else:
            entry, counts = add_links(spark, area.id, source.road_ways(elements), out)
        for r in counts.collect():
            LOG.info("%s: %s", area.name, ", ".join(f"{k} {v}" for k, v in r.asDict().items()))
        changed = entry if kind == "links" else {"id": area.id, "bytes": entry["bytes"]}
        places["routed"] = [r | changed if r["id"] == area.id else r for r in places["routed"]]
    write_places(out, places)
    return places
