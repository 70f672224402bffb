"""From files to a publication and its enrichment, through the command line."""

import json

import pytest
from pyspark.sql import functions as F

from streetloom.__main__ import main
from streetloom.functions import projection as P
from streetloom.plans import export
from streetloom.sources import areas, fetch, shapes

X, Y, ZONE, ID = 500_000.0, 7_400_000.0, 22, "4113700"


def degrees(spark, lines):
    """Lines in metres as lists of (lon, lat)."""
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line array<struct<x:double,y:double>>")
    rows = df.select("i", P.unproject_line(F.col("line"), F.lit(ZONE)).alias("l")).orderBy("i").collect()
    return [[(p.lon, p.lat) for p in r.l] for r in rows]


def crossroad():
    faces = []
    for dx, dy in ((6, 0), (0, 6)):
        for s in (1, -1):
            for t in (1, -1):
                near = (X + s * dx + t * (6 if dy else 0), Y + s * dy + t * (6 if dx else 0))
                faces.append([near, (near[0] if dx else X + t * 200.0, Y + t * 200.0 if dx else near[1])])
    return faces


def write(uri, doc):
    fetch.write_bytes(uri, json.dumps(doc).encode())


def read(path):
    return json.loads(path.read_text(encoding="utf-8"))


def test_publication_and_enrichment(spark, tmp_path):
    cache, out = f"file://{tmp_path}/cache", f"file://{tmp_path}/out"
    square = {"type": "Polygon", "coordinates": [[[-51.1234567, -23.0], [-51.0, -23.0], [-51.0, -22.5]]]}
    write(f"{cache}/states.json", [{"id": 41, "sigla": "PR", "nome": "Paraná"}])
    write(f"{cache}/states.geojson", {"features": [{"properties": {"codarea": "41"}, "geometry": square}]})
    write(f"{cache}/municipalities_41.json", [{"id": int(ID), "nome": "Londrina"}])
    write(f"{cache}/municipalities_41.geojson", {"features": [{"properties": {"codarea": c}, "geometry": square} for c in (ID, "99")]})
    lines = degrees(spark, crossroad())
    names = {"NM_TIP_LOG": ["RUA"] * 8, "NM_TIT_LOG": [""] * 8, "NM_LOG": ["A"] * 8}
    fetch.write_bytes(f"{cache}/PR_faces.zip", shapes.write_zip({f"PR/{ID}_faces": (lines, names), "PR/1_other": (lines[:1], {k: v[:1] for k, v in names.items()})}))
    write(f"{out}/places.json", {"routed": [{"id": "5300108", "bbox": [0, 0, 1, 1], "bytes": 5}, {"id": ID, "bbox": [], "bytes": 0}], "neighbourhoods": [{"area": "5300108", "code": "1"}, {"area": ID, "code": "2"}]})

    places = main(["export", "--area", ID, "--cache", cache, "--out", out], spark)
    assert read(tmp_path / "out/places.json") == json.loads(json.dumps(places))
    assert [m["name"] for m in places["municipalities"]] == ["99", "Londrina"] and places["states"][0]["bbox"] == [-51.12346, -23.0, -51.0, -22.5]
    assert [r["id"] for r in places["routed"]] == [ID, "5300108"] and [b["area"] for b in places["neighbourhoods"]] == ["5300108"]
    features = read(tmp_path / "out/municipalities/41.geojson")["features"]
    assert features[0]["geometry"]["coordinates"][0][0] == [-51.12346, -23.0] and not (tmp_path / f"out/neighbourhoods/{ID}.geojson").exists()
    graph = read(tmp_path / f"out/graph/{ID}.json")
    assert places["routed"][0]["bytes"] == len((tmp_path / f"out/graph/{ID}.json").read_text(encoding="utf-8"))
    assert (len(graph["edges"]) // 4, len(graph["nodes"]) // 2, graph["names"], graph["crs"], graph["bridged"]) == (4, 5, ["Rua A"], "EPSG:31982", [])
    assert 6500 < sum(graph["edges"][2::4]) < 8200

    # Ways against and along the four arms: three run to the middle, one away from it.
    arms = degrees(spark, [[(X + a, Y + b), (X, Y)] for a, b in ((210, 0), (-210, 0), (0, 210))] + [[(X, Y), (X, Y - 210)]])
    way = lambda i, line, **tags: {"type": "way", "id": i, "tags": {"highway": "primary"} | tags, "nodes": [10 * i, 10 * i + 1], "geometry": [{"lon": x, "lat": y} for x, y in line]}
    box = tuple(places["routed"][0]["bbox"])
    (tile,) = [fetch.tile_path(f"file://{tmp_path}/osm", f"{ID}/oneway", b) for b in export.source.tile_boxes(*box)]
    write(tile, {"elements": [way(i, line, oneway="yes") for i, line in enumerate(arms)]})
    for _ in range(2):  # a second run changes nothing
        places = main(["oneway", "--area", ID, "--cache", f"file://{tmp_path}/osm", "--out", out], spark)
        driven = read(tmp_path / f"out/graph/{ID}.json")
        # Dead ends can't be left again, so all directions are opened.
        assert driven["oneway"] == [] and driven["edges"] == graph["edges"] and "ODbL" in driven["directionSource"]
        assert places["routed"][0]["bytes"] == len((tmp_path / f"out/graph/{ID}.json").read_text(encoding="utf-8"))

    # A road around joins two arms' ends.
    ends = degrees(spark, [[(X + 195, Y + 5), (X + 190, Y + 190), (X + 5, Y + 195)]])
    write(fetch.tile_path(f"file://{tmp_path}/osm", f"{ID}/links", box), {"elements": [way(7, ends[0], ref="R7") | {"nodes": [1, 2, 3]}]})
    places = main(["links", "--area", ID, "--cache", f"file://{tmp_path}/osm", "--out", out], spark)
    linked = read(tmp_path / f"out/graph/{ID}.json")
    assert len(linked["edges"]) // 4 == 5 and "R7" in linked["names"] and "ODbL" in linked["linkSource"] and linked["directionSource"] == driven["directionSource"]
    assert places["routed"][0]["bbox"] == pytest.approx(list(box), abs=1e-3)
    # With the circle one-way directions can stay: along one side of it and around.
    write(tile, {"elements": [way(0, arms[0], oneway="yes"), way(1, arms[2][::-1], oneway="yes")]})
    main(["oneway", "--area", ID, "--cache", f"file://{tmp_path}/osm", "--out", out], spark)
    driven = read(tmp_path / f"out/graph/{ID}.json")
    assert len(driven["oneway"]) == 2 and driven["linkSource"] == linked["linkSource"]
    for e in driven["oneway"]:
        u, line = driven["edges"][4 * e], driven["lines"][e]
        near = lambda x, y, u=u: abs(x - driven["nodes"][2 * u]) + abs(y - driven["nodes"][2 * u + 1])
        assert near(*line[:2]) < near(*line[-2:])


def test_unknown_areas_are_refused(spark, tmp_path):
    with pytest.raises(KeyError, match="known are"):
        main(["export", "--area", "none"], spark)
    with pytest.raises(KeyError, match="has not been published"):
        export.enrich(spark, f"file://{tmp_path}", [areas.AREAS[0]], f"file://{tmp_path}", "oneway")
    with pytest.raises(SystemExit):
        main(["links"], spark)


def test_questions_to_the_map_service():
    assert fetch.oneway_query((1, 2, 3, 4)).count("(2,1,4,3)") == 3 and fetch.roads_query((1, 2, 3, 4)).count("residential") == 1
