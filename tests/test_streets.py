"""Tags, names, projection, direction matching, repair, links, sources and sinks."""

import gzip
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from streetloom.config import MatchParams
from streetloom.functions import lines as L
from streetloom.functions import projection as P
from streetloom.functions import text as T
from streetloom.operators import links, oneway, routing
from streetloom.operators.components import repaired
from streetloom.sinks import documents as sink
from streetloom.sources import areas, fetch, shapes
from streetloom.sources import documents as source

LINE = "array<struct<x:double,y:double>>"
SQUARE = [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]


def square(spark, bridged=()):
    rows = [(i, i, (i + 1) % 4, [SQUARE[i], SQUARE[(i + 1) % 4]], i in bridged) for i in range(4)]
    return spark.createDataFrame(rows, f"eid long, u long, v long, line {LINE}, bridged boolean")


def ways(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), f"way_id long, line {LINE}")


def matched(spark, way_lines, bridged=()):
    return {r.eid: r.direction for r in oneway.match_directions(square(spark, bridged), ways(spark, *way_lines)).collect()}


@pytest.mark.parametrize("tags, expected", [({"oneway": "yes"}, 1), ({"oneway": "-1"}, -1), ({"junction": "roundabout"}, 1), ({"highway": "motorway", "oneway": "no"}, 0), ({"highway": "residential"}, 0), ({"oneway": "reversible", "highway": "motorway"}, 1)])
def test_direction_of_tags(spark, tags, expected):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert df.select(T.direction(F.col("tags"))).first()[0] == expected


def test_names(spark):
    df = spark.createDataFrame([("RUA", " ", "PAPA-LEGUAS d'oeste"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(T.street_name(*map(F.col, "abc"))).collect()] == ["Rua Papa-Leguas D'Oeste", ""]


@pytest.mark.parametrize("lon, lat, epsg, x, y", [(-51.16, -23.31, 31982, 483640.624, 7422153.614), (-46.63, -23.55, 31983, 333624.181, 7394647.522), (-47.88, -15.79, 31983, 191433.037, 8252181.874)])
def test_projection(spark, lon, lat, epsg, x, y):
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    zone = P.zone_of(F.col("lon"))
    e, n = P.forward(F.col("lon"), F.col("lat"), zone)
    got = df.select(P.epsg_of(zone).alias("epsg"), zone.alias("z"), e.alias("x"), n.alias("y"))
    r = got.first()
    assert r.epsg == epsg and abs(r.x - x) < 1e-3 and abs(r.y - y) < 1e-3
    back = got.select(*P.inverse(F.col("x"), F.col("y"), F.col("z"))).first()
    assert abs(back[0] - lon) < 1e-7 and abs(back[1] - lat) < 1e-7


def test_lengths_are_quantised_half_to_even(spark):
    assert spark.range(1).select(L.quantised(F.lit(0.25))).first()[0] == 2


def test_match(spark):
    got = matched(spark, [[(-5.0, 4.0), (205.0, 4.0)], [(205.0, 196.0), (-5.0, 196.0)], [(204.0, 205.0), (204.0, -5.0)]])
    assert got == {0: 1, 2: 1, 1: -1}


@pytest.mark.parametrize("lines, bridged", [([[(-5.0, 40.0), (205.0, 40.0)]], ()), ([[(100.0, -50.0), (100.0, 50.0)]], ()), ([[(-5.0, 3.0), (205.0, 3.0)], [(205.0, -3.0), (-5.0, -3.0)]], ()), ([[(-5.0, 4.0), (205.0, 4.0)]], (0,))])
def test_no_match(spark, lines, bridged):
    assert matched(spark, lines, bridged) == {}


def test_degenerate_segments_by_option(spark):
    w = ways(spark, [(500000.0, 7400000.0), (500000.0, 7400050.0)])
    assert oneway.way_segments(w, MatchParams()).count() == 1
    assert oneway.way_segments(w, MatchParams(legacy_degenerate=True)).count() == 0


def test_repair(spark):
    cycle = [(i, i, (i + 1) % 4, True) for i in range(4)]
    assert repaired(spark.createDataFrame(cycle, "eid long, u long, v long, oneway boolean")).count() == 0
    spur = spark.createDataFrame([*cycle, (4, 1, 4, True)], "eid long, u long, v long, oneway boolean")
    assert 4 in {r.eid for r in repaired(spur).collect()}


def test_assigned_edges_are_turned(spark):
    w = ways(spark, [(205.0, 4.0), (-5.0, 4.0)])
    rows = {r.eid: r for r in oneway.assign_oneway(square(spark), w).collect()}
    assert rows[0].oneway and (rows[0].u, rows[0].v) == (1, 0) and rows[0].line[0].x == 200.0
    assert not rows[1].oneway and (rows[1].u, rows[1].v) == (1, 2)


def test_ways_are_cut_at_shared_nodes(spark):
    rows = [(1, {"highway": "primary"}, [1, 2, 3], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (2, {"highway": "primary", "oneway": "-1"}, [5, 2, 4], [(1.0, -1.0), (1.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, f"way_id long, tags map<string,string>, nodes array<long>, line {LINE}")
    assert sorted((r.a, r.b, r.dir) for r in links.way_pieces(df).collect()) == [(1, 2, 0), (2, 3, 0), (2, 5, 1), (4, 2, 1)]


def test_a_road_joins_two_parts(spark):
    xy = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (1000.0, 0.0), 3: (1100.0, 0.0)}
    nodes = spark.createDataFrame([(i, *p) for i, p in xy.items()], "id long, x double, y double")
    e = [(0, 0, 1, 100.0, [xy[0], xy[1]], False, False, "A"), (1, 2, 3, 100.0, [xy[2], xy[3]], False, False, "B")]
    edges = spark.createDataFrame(e, f"eid long, u long, v long, length double, line {LINE}, bridged boolean, oneway boolean, name string")
    w = [(7, {"highway": "primary", "ref": "R1"}, [10, 11], [(105.0, 0.0), (960.0, 0.0)]), (8, {"highway": "residential"}, [12, 13], [(0.0, 50.0), (0.0, 500.0)])]
    roads_ = spark.createDataFrame(w, f"way_id long, tags map<string,string>, nodes array<long>, line {LINE}")
    new_nodes, new_edges = links.connect(nodes, edges, roads_)
    got = new_edges.collect()
    assert new_nodes.count() == 5 and len(got) == 4
    assert sorted(r.name for r in got) == ["", "A", "B", "R1"]
    (tie,) = [r for r in got if r.bridged]
    assert tie.length == pytest.approx(40.0)


def test_map_elements(spark, tmp_path):
    way = {"type": "way", "id": 7, "tags": {"highway": "primary", "oneway": "-1"}, "nodes": [1, 2], "geometry": [{"lon": 1, "lat": 2}, {"lon": 3, "lat": 4}]}
    other = way | {"tags": {"highway": "secondary", "oneway": "yes"}}
    (tmp_path / "t0.json").write_text(json.dumps({"elements": [way, {"type": "node", "id": 1}, way | {"id": 8, "tags": None}]}))
    (tmp_path / "t1.json").write_text(json.dumps({"elements": [other]}))
    elements = source.map_elements(spark, str(tmp_path))
    (r,) = source.oneway_ways(elements).collect()
    assert (r.way_id, r.highway, [(p.lon, p.lat) for p in r.coords]) == (7, "primary", [(3.0, 4.0), (1.0, 2.0)])
    assert {x.way_id for x in source.road_ways(elements).collect()} == {7, 8}


def test_places_and_boundaries(spark, tmp_path):
    (tmp_path / "states.json").write_text(json.dumps([{"id": 41, "sigla": "PR", "nome": "Paraná"}]))
    geo = {"features": [{"properties": {"codarea": "41"}, "geometry": {"type": "Polygon", "coordinates": [[[1.5, 2.0]]]}}, {"properties": {"codarea": "99"}, "geometry": {"type": "Polygon", "coordinates": []}}]}
    (tmp_path / "geo.json").write_text(json.dumps(geo))
    names, features = source.places(spark, str(tmp_path / "states.json")), source.boundaries(spark, str(tmp_path / "geo.json"))
    assert [(r.code, r.name) for r in source.named_boundaries(features, names, True).orderBy("code").collect()] == [(41, "Paraná"), (99, "99")]
    assert source.named_boundaries(features, names, False).count() == 1


def test_missing_table_is_empty(spark, tmp_path):
    assert source.optional(spark, str(tmp_path / "none"), "CD_MUN string").columns == ["CD_MUN"]
    assert source.of_municipality(spark.createDataFrame([(5,), (6,)], "CD_MUN int"), "5").count() == 1


def shp(lines):
    body = b""
    for i, line in enumerate(lines):
        rec = struct.pack("<i4d2ii", 3, 0, 0, 0, 0, 1, len(line), 0) + b"".join(struct.pack("<2d", *p) for p in line)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8) + body


def dbf(rows, fields):
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in fields)
    size = 1 + sum(w for _, w in fields)
    data = b"".join(b" " + b"".join(v.encode().ljust(w) for v, (_, w) in zip(row, fields, strict=True)) for row in rows)
    return struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + len(head) + 1, size) + head + b"\r" + data


def test_zipped_shapefile(spark, tmp_path):
    fields = [("NM_TIP_LOG", 10), ("NM_TIT_LOG", 10), ("NM_LOG", 10)]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for member in ("PR/41_faces", "PR/42_faces"):
            z.writestr(f"{member}.shp", shp([[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]))
            z.writestr(f"{member}.dbf", dbf([("RUA", "", "A"), ("", "", "")], fields))
    (tmp_path / "x.zip").write_bytes(raw.getvalue())
    faces = shapes.face_table(shapes.zipped_shapes(spark, str(tmp_path / "x.zip"), "PR/41_"))
    assert sorted((r.name, r.line[0].x) for r in faces.collect()) == [("", 2.0), ("Rua A", 0.0)]


def test_payload_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, -51.123456789, -23.0), (1, -51.0, -23.1)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 0, 1, 0.25, "B", [(-51.123456789, -23.0), (-51.0, -23.1)], False), (1, 1, 0, 12.34, "A", [(-51.0, -23.1), (-51.1, -23.0)], True)], "eid long, u long, v long, length double, name string, line array<struct<lon:double,lat:double>>, bridged boolean")
    text = sink.graph_payload(nodes, edges, "41", "X", [41], "s", "EPSG:31982", {"half_width_m": 8.0}).first().payload
    doc = json.loads(text)
    assert doc["names"] == ["B", "A"] and doc["bridged"] == [1] and doc["edges"] == [0, 1, 2, 0, 1, 0, 123, 1] and doc["nodes"][0] == -51.12346
    (tmp_path / "g.json").write_text(text)
    back = source.payload(spark, str(tmp_path / "g.json"))
    assert [(r.eid, r.u, r.length, r.name, r.bridged) for r in source.payload_edges(back).orderBy("eid").collect()] == [(0, 0, 0.2, "B", False), (1, 1, 12.3, "A", True)]
    assert source.payload_nodes(back).count() == 2
    assert sink.payload_box(back).first().bbox == [-51.12346, -23.1, -51.0, -23.0]


def test_places_merge_in_catalogue_order(spark):
    table = areas.catalogue(spark, [areas.Area("a", "A", "PR", (1,)), areas.Area("b", "B", "SP", (2, 3))])
    old, new = spark.createDataFrame([("b", 1), ("a", 1)], "id string, n int"), spark.createDataFrame([("b", 2)], "id string, n int")
    assert [(r.id, r.n) for r in sink.merged_places(old, new, table).collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(KeyError, match="known are a, b"):
        areas.area([areas.Area("a", "A", "PR", (1,)), areas.Area("b", "B", "SP", ())], "c")


def test_features_by_group(spark, tmp_path):
    df = spark.createDataFrame([("PR", 2, "y"), ("PR", 1, "x"), ("SP", 1, "z")], "uf string, k int, name string")
    f = df.select("uf", "k", sink.feature(F.array(F.lit(1.5), F.lit(2.0)), F.lit("Point"), name=F.col("name")).alias("feature"))
    docs = sink.feature_collections(f, "uf", "k")
    got = {r.uf: json.loads(r.json) for r in docs.collect()}
    assert [x["properties"]["name"] for x in got["PR"]["features"]] == ["x", "y"]
    out = f"file://{tmp_path}/out"
    sink.write_documents(docs, out, "uf")
    assert {r.uf: r.chars for r in sink.write_documents(docs.where("uf = 'PR'"), out, "uf").collect()} == {"PR": len(docs.where("uf = 'PR'").first().json)}
    assert spark.read.text(out).count() == 2


def test_fetch_unpacks_and_caches(tmp_path):
    calls = []

    def opener(request, timeout=None):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise OSError("busy")
        return io.BytesIO(gzip.compress(b"{}"))

    waits = []
    path = fetch.fetch_tile("http://example.org/x", "q", f"file://{tmp_path}/a.json", opener=opener, sleep=waits.append)
    assert (tmp_path / "a.json").read_bytes() == b"{}" and waits == [30.0, 2.0]
    fetch.fetch_tile("http://example.org/x", "q", path, opener=opener)
    assert len(calls) == 2
    assert fetch.tile_path("file:///x", "k", (0, 0, 1, 1)) != fetch.tile_path("file:///x", "k", (0, 0, 1, 2))


def test_tiles():
    got = source.tile_boxes(0.0, 0.0, 0.5, 0.2)
    assert len(got) == 3 and got[0] == (0.0, 0.0, pytest.approx(0.5 / 3), 0.2)


def test_routes_metrics_and_ranks(spark):
    nodes = spark.createDataFrame([("a", i * 4 + j, 100.0 * i, 100.0 * j) for i in range(4) for j in range(4)], "area string, id long, x double, y double")
    links_ = [(i * 4 + j, b) for i in range(4) for j in range(4) for b in ([i * 4 + j + 1] if j < 3 else []) + ([i * 4 + j + 4] if i < 3 else [])]
    edges = spark.createDataFrame([("a", u, v, 100.0) for u, v in links_], "area string, u long, v long, length double")
    pairs = spark.createDataFrame([("a", 0, 0, 15), ("a", 1, 3, 12)], "area string, pair long, a long, b long")
    runs = routing.run_finders(nodes, edges, pairs, ["dijkstra", "astar", "greedy"], parts=2)
    got = {r.algo: r for r in routing.metrics(runs).collect()}
    assert got["astar"].gap == pytest.approx(0.0) and got["greedy"].success == 1.0
    assert {r.cost for r in runs.where("algo = 'dijkstra'").collect()} == {600.0}
    scores = spark.createDataFrame([(b, m, v) for b in range(4) for m, v in (("x", 1.0), ("y", 2.0), ("z", 2.0))], "b int, m string, v double")
    r = routing.friedman(scores, "b", "m", "v").first()
    assert (r.n, r.k) == (4, 3) and r.chi2 == pytest.approx(12 * 4 / 12 * (1 + 2 * 2.5**2 - 12))
    with pytest.raises(ValueError, match="unknown algorithm"):
        routing.run_finders(nodes, edges, pairs, ["none"])
