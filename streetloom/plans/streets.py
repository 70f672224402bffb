"""Further named queries: files and documents, corridors and pixels, links, directions and path finders.

Like the catalogue's, they run the operators on stand-ins made of the driver's tables, and SQL says the same without them.
"""

from __future__ import annotations

import gzip
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CorridorParams, LinkParams, MatchParams
from ..functions import lines as L
from ..functions import text as T
from ..operators import components as C
from ..operators import corridor, detours, grid, links, oneway, roads, routing
from ..sinks import documents as sink
from ..sources import areas, fetch, shapes
from ..sources import documents as source
from ..tables import materialise, new_path, table
from . import export
from .build import name_edges, simplified
from .catalogue import CHAINS, FLOWS, PIXELS, POINTS, _turn, chains, flows, nation_lines, nation_segments, pixels, points, query, town

XY = "array<struct<x:double,y:double>>"


def _point(x, y):
    as_double = lambda v: (v if not isinstance(v, (int, float)) else F.lit(v)).cast("double")
    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"))


def _write(docs: DataFrame, uri: str) -> DataFrame:
    return sink.write_documents(docs.select("file", "json"), uri, "file")


# --- files and documents ---------------------------------------------------------------------------------------------


@query("SELECT p_size AS size, CAST(length(CAST(to_json(list({'id': p_partkey, 'name': p_name} ORDER BY p_partkey)) AS VARCHAR)) AS BIGINT) AS chars, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_size")
def document_round_trip(spark, d):
    """Compact documents of parts by size, written with their number of characters and scanned again."""
    rows = table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    docs = rows.groupBy("size").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("json"))
    uri, file = new_path(spark, "documents"), F.concat(F.lit("size-"), F.col("size"), F.lit(".json"))
    written = _write(docs.withColumn("file", file), uri)
    back = source.whole_files(spark, uri, "array<struct<id:bigint,name:string>>").select(F.regexp_extract("path", r"(size-\d+[.]json)$", 1).alias("file"), F.size("doc").cast("long").alias("n"))
    return back.join(written, "file").select(F.regexp_extract("file", r"(\d+)", 1).cast(rows.schema["size"].dataType).alias("size"), "chars", "n")


def _publication(spark, d) -> export.Cache:
    """Regions as states, nations as their municipalities: squares, and one nation without a name."""
    uri = new_path(spark, "cache")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.substring("r_name", 1, 2).alias("sigla"), F.col("r_name").alias("nome"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"), F.substring("n_name", 1, 2).alias("sigla"), F.col("n_name").alias("nome"))
    listed = lambda rows: F.to_json(F.array_sort(F.collect_list(F.struct("id", "sigla", "nome")))).alias("json")
    docs = r.agg(listed(r)).withColumn("file", F.lit("states.json"))
    docs = docs.unionByName(n.where("id <> 7").groupBy("region").agg(listed(n)).select("json", F.concat(F.lit("municipalities_"), "region", F.lit(".json")).alias("file")))
    at = lambda k: F.format_string("[%s,%s]", F.col("id") * 1.0000049 + k, F.col("id") * -0.5000049 - k)
    ring = F.concat(F.lit("[["), F.concat_ws(",", *(at(k) for k in (0.125, 0.25, 0.375, 0.125))), F.lit("]]"))
    shape = F.concat(F.lit('{"properties":{"codarea":"'), F.col("id"), F.lit('"},"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    doc = F.concat(F.lit('{"features":['), F.array_join(F.array_sort(F.collect_list(shape)), ","), F.lit("]}")).alias("json")
    docs = docs.unionByName(r.agg(doc).withColumn("file", F.lit("states.geojson")))
    docs = docs.unionByName(n.groupBy("region").agg(doc).select("json", F.concat(F.lit("municipalities_"), "region", F.lit(".geojson")).alias("file")))
    _write(docs, uri)
    return export.Cache(uri)


@query("SELECT 'state' AS level, CAST(r_regionkey AS BIGINT) AS id, substr(r_name, 1, 2) AS sigla, r_name AS nome FROM region UNION ALL SELECT 'municipality', CAST(n_nationkey AS BIGINT), substr(n_name, 1, 2), n_name FROM nation WHERE n_nationkey <> 7")
def places_scan(spark, d):
    cache = _publication(spark, d)
    of = lambda level, name: source.places(spark, cache.document(name)).select(F.lit(level).alias("level"), "id", "sigla", "nome")
    return of("state", "states.json").unionByName(of("municipality", "municipalities_*.json"))


_BOX = "round_even({k} * 1.0000049e0 + 0.125e0, 5) AS x0, round_even({k} * -0.5000049e0 - 0.375e0, 5) AS y0, round_even({k} * 1.0000049e0 + 0.375e0, 5) AS x1, round_even({k} * -0.5000049e0 - 0.125e0, 5) AS y1"


@query(f"""SELECT 'state' AS level, CAST(r_regionkey AS BIGINT) AS code, substr(r_name, 1, 2) AS uf, CAST(r_regionkey AS BIGINT) AS state, r_name AS name, {_BOX.format(k="r_regionkey")} FROM region
UNION ALL SELECT 'municipality', CAST(n_nationkey AS BIGINT), substr(r_name, 1, 2), CAST(n_regionkey AS BIGINT), CASE WHEN n_nationkey = 7 THEN '7' ELSE n_name END, {_BOX.format(k="n_nationkey")} FROM nation JOIN region ON n_regionkey = r_regionkey""")
def boundary_places(spark, d):
    """Boundaries scanned, named and boxed, as places.json lists them."""
    states, parts = export.boundaries(spark, _publication(spark, d), new_path(spark, "published"))
    both = states.select(F.lit("state").alias("level"), "code", "uf", F.col("code").alias("state"), "name", "bbox").unionByName(parts.select(F.lit("municipality").alias("level"), "code", "uf", "state", "name", "bbox"))
    return both.select("level", "code", "uf", "state", "name", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS state, CAST(n_nationkey AS BIGINT) AS code, 'Polygon' AS kind, CASE WHEN n_nationkey = 7 THEN '7' ELSE n_name END AS name,
  round_even(n_nationkey * 1.0000049e0 + 0.25e0, 5) AS x, round_even(n_nationkey * -0.5000049e0 - 0.25e0, 5) AS y FROM nation""")
def boundary_files(spark, d):
    """The written boundary documents of the states, read back."""
    out = new_path(spark, "published")
    export.boundaries(spark, _publication(spark, d), out)
    form = "struct<type:string,features:array<struct<type:string,properties:struct<code:bigint,name:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"
    docs = source.whole_files(spark, f"{out}/municipalities", form).select(F.regexp_extract("path", r"(\d+)[.]geojson$", 1).cast("long").alias("state"), F.explode("doc.features").alias("f"))
    second = F.col("f.geometry.coordinates")[0][1]
    return docs.select("state", F.col("f.properties.code").alias("code"), F.col("f.geometry.type").alias("kind"), F.col("f.properties.name").alias("name"), second[0].alias("x"), second[1].alias("y"))


def _zipped(spark, d, uri: str, name: str) -> None:
    """A zip of shapefiles, a member for each region: a line per nation. Nations are 25 rows."""
    rows = [(r.n_regionkey, r.n_nationkey, r.n_name) for r in table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    members = {}
    for region in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == region]
        fields = {"NM_TIP_LOG": ["RUA"] * len(own), "NM_TIT_LOG": [""] * len(own), "NM_LOG": [r[2] for r in own], "CD_MUN": [str(region)] * len(own), "CD_BAIRRO": [f"B{r[1]}" for r in own], "NM_BAIRRO": [r[2] for r in own]}
        members[f"XX/{region}_faces"] = ([[(r[1] + 0.5, -1.0), (r[1] + 1.5, -2.25)] for r in own], fields)
    fetch.write_bytes(f"{uri}/{name}", shapes.write_zip(members))


@query("SELECT array_to_string(list_transform(string_split('rua ' || lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, n_nationkey + 0.5e0 AS x0, -1e0 AS y0, n_nationkey + 1.5e0 AS x1, -2.25e0 AS y1 FROM nation WHERE n_regionkey IN (1, 3)")
def zipped_faces(spark, d):
    """Block faces of two members of a zip, chosen by the names of its members, as one area."""
    uri = new_path(spark, "cache")
    _zipped(spark, d, uri, "XX_faces.zip")
    f = export.faces_of(spark, export.Cache(uri), areas.Area("a", "A", "XX", (1, 3)))
    return f.select("name", *(F.col("line")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in "xy"))


@query("""SELECT 'B' || n_nationkey AS code, n_name AS name, CAST(n_regionkey AS INTEGER) AS municipality, 'a' AS area, n_nationkey + 0.5e0 AS x0, -2.25e0 AS y0, n_nationkey + 1.5e0 AS x1, -1e0 AS y1, CAST((SELECT count(*) FROM nation WHERE n_regionkey IN (0, 2)) AS BIGINT) AS written
FROM nation WHERE n_regionkey IN (0, 2)""")
def neighbourhood_entries(spark, d):
    """Neighbourhoods of an area's members, with how many its document holds; an area without a file has none."""
    uri, out = new_path(spark, "cache"), new_path(spark, "published")
    _zipped(spark, d, uri, "XX_neighbourhoods.zip")
    entries = export.neighbourhoods(spark, export.Cache(uri), areas.Area("a", "A", "XX", (0, 2)), out)
    none = export.neighbourhoods(spark, export.Cache(uri), areas.Area("b", "B", "YY", (1,)), out)
    n = source.whole_files(spark, f"{out}/neighbourhoods", "struct<features:array<struct<type:string>>>").agg(F.sum(F.size("doc.features")).cast("long").alias("written"))
    return entries.unionByName(none).select("code", "name", "municipality", "area", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))).crossJoin(n)  # n is one row


@query("""WITH b AS (SELECT r_regionkey AS k, 0.07e0 * (r_regionkey + 1) AS w, 0.11e0 * (r_regionkey + 1) AS h FROM region), n AS (SELECT *, greatest(1, CAST(ceil(w / 0.2e0) AS INTEGER)) AS nx, greatest(1, CAST(ceil(h / 0.2e0) AS INTEGER)) AS ny FROM b)
SELECT CAST(k AS BIGINT) AS k, CAST(i * ny + j AS INTEGER) AS tile, round(i * (w / nx), 9) AS x0, round(j * (h / ny), 9) AS y0, round((i + 1) * (w / nx), 9) AS x1, round((j + 1) * (h / ny), 9) AS y1 FROM (SELECT *, unnest(range(0, nx)) AS i FROM n), (SELECT unnest(range(0, 10)) AS j) WHERE j < ny""")
def box_tiles(spark, d):
    """Tiles of growing boxes, one box for each region (five rows)."""
    keys = [r.r_regionkey for r in table(spark, d, "region").collect()]
    rows = [(k, i, *(float(c) for c in box)) for k in keys for i, box in enumerate(source.tile_boxes(0.0, 0.0, 0.07 * (k + 1), 0.11 * (k + 1)))]
    out = spark.createDataFrame(rows, "k long, tile int, x0 double, y0 double, x1 double, y1 double")
    return out.select("k", "tile", *(F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")))


_TILES = """el AS (SELECT event_id AS id, user_id % 4 AS tile, event_id % 5 AS kind, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway, floor(value) AS v FROM events),
tiled AS (SELECT * FROM el UNION ALL SELECT id, tile + 1, kind, 'yes', v FROM el WHERE id % 4 = 0)"""


def _map_tiles(spark, d) -> DataFrame:
    """Events as ways of four tiles; some are nodes, lack their geometry or have fewer points; each fourth is in two tiles."""
    e = table(spark, d, "events")
    id_, kind = F.col("event_id").cast("long"), F.col("event_id") % 5
    at = lambda k: F.struct((F.floor("value") + k).cast("double").alias("lon"), F.lit(float(k)).alias("lat"))
    way = F.when(F.col("event_id") % 3 == 0, "yes").when(F.col("event_id") % 3 == 1, "-1")
    body = lambda tag: F.struct(F.when(kind == 0, "node").otherwise("way").alias("type"), id_.alias("id"), F.struct(tag.alias("oneway"), F.lit("primary").alias("highway"), F.when(kind == 4, F.concat(F.lit("R"), id_)).alias("ref")).alias("tags"), F.array(id_ * 10, id_ * 10 + 1).alias("nodes"), F.when(kind != 1, F.when(kind == 2, F.array(at(0))).otherwise(F.array(at(0), at(1)))).alias("geometry"))
    rows = e.select((F.col("user_id") % 4).alias("tile"), F.col("event_id").alias("o"), body(way).alias("el"))
    rows = rows.unionByName(e.where("event_id % 4 = 0").select((F.col("user_id") % 4 + 1).alias("tile"), F.col("event_id").alias("o"), body(F.lit("yes")).alias("el")))
    docs = rows.groupBy("tile").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("o", "el"))), lambda x: x["el"]).alias("elements"))).alias("json"))
    uri = new_path(spark, "tiles")
    _write(docs.withColumn("file", F.concat(F.lit("t"), "tile", F.lit(".json"))), uri)
    return source.map_elements(spark, uri)


@query(f"""WITH {_TILES}, one AS (SELECT * FROM tiled WHERE kind <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY tile) = 1)
SELECT id AS way_id, v + CASE WHEN oneway = '-1' AND kind <> 2 THEN 1 ELSE 0 END AS lon, CAST(CASE WHEN kind = 2 THEN 1 ELSE 2 END AS BIGINT) AS n, 'primary' AS highway FROM one WHERE kind <> 1 AND oneway IS NOT NULL""")
def oneway_tiles(spark, d):
    """Ways with a direction from overlapping tiles, each from its first tile, in driving order."""
    return source.oneway_ways(_map_tiles(spark, d)).select("way_id", F.col("coords")[0]["lon"].alias("lon"), F.size("coords").cast("long").alias("n"), "highway")


@query(f"""WITH {_TILES}, one AS (SELECT * FROM tiled WHERE kind <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY tile) = 1)
SELECT id AS way_id, oneway, CASE WHEN kind = 4 THEN 'R' || id ELSE '' END AS name, id * 10 AS first FROM one WHERE kind IN (3, 4)""")
def road_tiles(spark, d):
    """Ways with as many nodes as points, and their names: the name, else the number, else nothing."""
    ways = source.road_ways(_map_tiles(spark, d))
    return ways.select("way_id", F.col("tags")["oneway"].alias("oneway"), T.first_filled(F.col("tags")["name"], F.col("tags")["ref"]).alias("name"), F.col("nodes")[0].alias("first"))


_CLASSES = "motorway|motorway_link|trunk|trunk_link|primary|primary_link|secondary|secondary_link|tertiary|tertiary_link|unclassified|residential|living_street"


@query(rf"""WITH b AS (SELECT r_regionkey, '(' || r_regionkey || '.5,-1.25,' || (r_regionkey + 1) || '.5,2.0)' AS b FROM region)
SELECT CAST(r_regionkey AS BIGINT) AS k, 'oneway' AS kind, '[out:json][timeout:240];' || chr(10) || '(' || chr(10) || '  way["highway"]["oneway"~"^(yes|1|true|-1|reverse)$"]' || b || ';' || chr(10) || '  way["highway"]["junction"~"^(roundabout|circular)$"]["oneway"!="no"]' || b || ';' || chr(10)
  || '  way["highway"~"^motorway$"]["oneway"!="no"]' || b || ';' || chr(10) || ');' || chr(10) || 'out tags geom;' AS text FROM b
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'roads', '[out:json][timeout:240];' || chr(10) || 'way["highway"~"^({_CLASSES})$"]["area"!="yes"]["access"!~"^(private|no)$"]' || b || ';' || chr(10) || 'out body geom;' FROM b""")
def map_queries(spark, d):
    """The texts that the map service is asked with, for a box of each region."""
    rows = [(r.r_regionkey, kind, f((-1.25, r.r_regionkey + 0.5, 2.0, r.r_regionkey + 1.5))) for r in table(spark, d, "region").collect() for kind, f in (("oneway", fetch.oneway_query), ("roads", fetch.roads_query))]
    return spark.createDataFrame(rows, "k long, kind string, text string")


_ACCESS = "CASE event_id % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'yes' END"


@query(f"SELECT event_id, class IN ('{_CLASSES.replace('|', chr(39) + ', ' + chr(39))}') AND coalesce(access, '') NOT IN ('private', 'no') AND coalesce(area, '') <> 'yes' AS road, class <> '' AND (coalesce(way, '') IN ('yes', '-1') OR (class = 'motorway' AND coalesce(way, '') <> 'no')) AS maybe FROM (SELECT event_id, {_ACCESS} AS access, CASE WHEN event_id % 7 = 0 THEN 'yes' END AS area, CASE event_type WHEN 'click' THEN 'motorway' WHEN 'error' THEN 'footway' WHEN 'view' THEN 'residential' ELSE 'primary' END AS class, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '-1' END AS way FROM events)")
def road_predicates(spark, d):
    """What the two questions to the map service select, as predicates on tags; absent tags pass."""
    from ..config import MAJOR_ROADS, MINOR_ROADS

    id_ = F.col("event_id")
    tags = F.create_map(F.lit("highway"), F.when(F.col("event_type") == "click", "motorway").when(F.col("event_type") == "error", "footway").when(F.col("event_type") == "view", "residential").otherwise("primary"), F.lit("access"), F.when(id_ % 4 == 0, "private").when(id_ % 4 == 1, "yes"), F.lit("area"), F.when(id_ % 7 == 0, "yes"), F.lit("oneway"), F.when(id_ % 5 == 0, "yes").when(id_ % 5 == 1, "no").when(id_ % 5 == 2, "-1"))
    return table(spark, d, "events").select("event_id", T.is_road(tags, MAJOR_ROADS + MINOR_ROADS).alias("road"), T.maybe_oneway(tags).alias("maybe"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(2 AS BIGINT) AS asked FROM nation")
def cached_files(spark, d):
    """A service that is busy once and then answers with gzip; its answer is fetched once, and read from the cache."""
    rows = [{"k": r.n_nationkey, "name": r.n_name} for r in table(spark, d, "nation").collect()]
    asked: list[str] = []

    def opener(request, timeout=None):
        asked.append(request.full_url)
        if len(asked) == 1:
            raise OSError("busy")
        return io.BytesIO(gzip.compress(json.dumps(rows).encode()))

    uri = fetch.tile_path(new_path(spark, "cache"), "nations", (0.0, 0.0, 1.0, 1.0))
    for _ in range(3):
        fetch.fetch_tile("http://localhost/", "q", uri, opener=opener, sleep=lambda s: None)
    found = source.whole_files(spark, uri, "array<struct<k:bigint,name:string>>").select(F.inline("doc"))
    return found.withColumn("asked", F.lit(len(asked)).cast("long"))


@query("""SELECT * FROM (VALUES ('4113700', 'Londrina', 'PR', CAST(1 AS BIGINT), CAST(0 AS INTEGER)), ('4106902', 'Curitiba', 'PR', 1, 1), ('4115200', 'Maringá', 'PR', 1, 2), ('4205407', 'Florianópolis', 'SC', 1, 3), ('5300108', 'Brasília', 'DF', 1, 4), ('3550308', 'São Paulo', 'SP', 1, 5), ('abc-paulista', 'ABC Paulista', 'SP', 7, 6)) AS t(id, name, uf, members, ordinal)""")
def area_catalogue(spark, d):
    return areas.catalogue(spark, list(areas.AREAS)).select("id", "name", "uf", F.size("municipalities").cast("long").alias("members"), "ordinal")


@query("SELECT c_nationkey AS area, 'c' || c_custkey AS face, c_acctbal AS v, CAST(NULL AS VARCHAR) AS s FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey, s_acctbal, s_name FROM supplier")
def area_union(spark, d):
    """Tables of several members as one; a column that a member lacks is null there."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("area"), F.concat(F.lit("c"), "c_custkey").alias("face"), F.col("c_acctbal").alias("v"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("area"), F.concat(F.lit("s"), "s_suppkey").alias("face"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("s"))
    return areas.union([c, s])


def _documents(spark, d) -> tuple[DataFrame, str]:
    """A graph document of the points of each label: neighbours in the order of their ids are joined."""
    p = points(spark, d).withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("id")) - 1)
    uri = new_path(spark, "graphs")
    for (label,) in p.select("label").distinct().orderBy("label").limit(2).collect():
        own = materialise(p.where(F.col("label") == label).select(F.col("n").cast("long").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat")), "points")
        e = own.where("id > 0").select((F.col("id") - 1).alias("eid"), (F.col("id") - 1).alias("u"), F.col("id").alias("v"), (F.abs("lon") * 100).alias("length"), F.concat(F.lit("name "), F.col("id") % 3).alias("name"), F.array(F.struct("lon", "lat"), F.struct(F.lit(0.25).alias("lon"), F.lit(0.5).alias("lat"))).alias("line"), (F.col("id") % 4 == 0).alias("bridged"), (F.col("id") % 5 == 0).alias("oneway"))
        doc = sink.graph_payload(own, materialise(e, "points-edges"), str(label), "P", [1], "points", "EPSG:31982", {"half_width_m": 8.0}, {"directionSource": "d"})
        _write(doc.select(F.lit(f"{label}.json").alias("file"), F.col("payload").alias("json")), uri)
    return source.payload(spark, uri), uri


_LABELS = f"{POINTS}, own AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS n, x, y FROM pts WHERE label IN (SELECT DISTINCT label FROM pts ORDER BY label LIMIT 2))"


@query(f"""WITH {_LABELS} SELECT CAST(label AS BIGINT) AS label, CAST(n - 1 AS BIGINT) AS eid, CAST(n - 1 AS BIGINT) AS u, CAST(n AS BIGINT) AS v, round_even(abs(x) * 1000, 0) / 10 AS length, 'name ' || n % 3 AS name, round_even(x, 5) + 0.0 AS lon, 0.5e0 AS lat, n % 4 = 0 AS bridged, n % 5 = 0 AS oneway, 'd' AS note FROM own WHERE n > 0""")
def payload_edges(spark, d):
    """Edges of written graph documents with their flags, lines, names and further attributes."""
    docs, _ = _documents(spark, d)
    label = F.regexp_extract("path", r"(\d+)[.]json$", 1).cast("long").alias("label")
    e = source.payload_edges(docs).join(docs.select("path", F.col("directionSource").alias("note")), "path")
    return e.select(label, "eid", "u", "v", F.round("length", 1).alias("length"), "name", (F.col("line")[0]["lon"] + 0.0).alias("lon"), F.col("line")[1]["lat"].alias("lat"), "bridged", "oneway", "note")


@query(f"WITH {_LABELS} SELECT CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS id, round_even(x, 5) + 0.0 AS lon, round_even(y, 5) + 0.0 AS lat FROM own")
def payload_nodes(spark, d):
    docs, _ = _documents(spark, d)
    return source.payload_nodes(docs).select(F.regexp_extract("path", r"(\d+)[.]json$", 1).cast("long").alias("label"), "id", (F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat"))


@query(f"WITH {_LABELS} SELECT CAST(label AS VARCHAR) AS id, 'Area ' || label AS name, min(round_even(x, 5)) AS x0, min(round_even(y, 5)) AS y0, max(round_even(x, 5)) AS x1, max(round_even(y, 5)) AS y1 FROM own GROUP BY label")
def area_boxes(spark, d):
    """Boxes of graph documents looked up by area."""
    docs, _ = _documents(spark, d)
    boxes = sink.payload_box(docs).select(F.regexp_extract("path", r"(\d+)[.]json$", 1).alias("id"), "bbox")
    listed = areas.catalogue(spark, [areas.Area(str(k), f"Area {k}", "XX", (k,)) for k in range(20)])
    return boxes.join(listed, "id").select("id", "name", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"WITH {CHAINS} SELECT CAST(conv_id % 7 AS INTEGER) AS class, CAST(count(*) AS BIGINT) AS edges, round(sum(length) / 1000, 6) AS km, CAST(count(*) FILTER (eid % 3 = 0) AS BIGINT) AS links, round(coalesce(sum(length) FILTER (eid % 3 = 0), 0) / 1000, 6) AS links_km FROM e GROUP BY conv_id % 7")
def edge_totals(spark, d):
    e = chains(spark, d).withColumn("class", (F.floor(F.col("eid") / 10000) % 7).cast("int")).withColumn("bridged", F.col("eid") % 3 == 0)
    return export.totals(e, "class").select("class", "edges", F.round("km", 6).alias("km"), "links", F.round("links_km", 6).alias("links_km"))


@query("SELECT * FROM (VALUES (0, 'read', 25e0), (1, 'joined', 25e0), (2, 'counted', 5e0)) AS t(n, stage, rows)")
def stage_log(spark, d):
    """The log of a run's stages, with the number of rows of each."""
    log = export.Stages()
    n = table(spark, d, "nation")
    log.lap("read", rows=n.count())
    r = n.join(table(spark, d, "region"), n.n_regionkey == F.col("r_regionkey"))
    log.lap("joined", rows=r.count())
    log.lap("counted", rows=r.groupBy("r_name").count().count())
    return log.table(spark).where("seconds >= 0").select("n", "stage", F.col("counts")["rows"].alias("rows"))


# --- lines, joins, parts ---------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS k, CASE WHEN abs(s_acctbal) <= abs(s_acctbal - 5000) THEN 0e0 ELSE 5000e0 END AS first, CASE WHEN abs(s_acctbal - 2500) * 0.001 > 3 THEN 3 ELSE 2 END AS kept FROM supplier""")
def turned_and_simplified(spark, d):
    """Lines from 0 to 5000 turned towards a point, and with a bend kept if it lies far enough off."""
    b = F.col("s_acctbal")
    line = F.array(_point(0.0, 0.0), _point(5000.0, 0.0))
    bend = F.array(_point(0.0, 0.0), _point(F.lit(2500.0), (b - 2500) * 0.001), _point(5000.0, 0.0))
    rows = table(spark, d, "supplier").select("s_suppkey", L.oriented(line, b, F.lit(0.0)).alias("line"), simplified(bend, 3.0).alias("bent"))
    return rows.select(F.col("s_suppkey").alias("k"), F.col("line")[0]["x"].alias("first"), F.size("bent").alias("kept"))


@query(f"""WITH RECURSIVE {FLOWS}, r(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT r.a, f.v FROM r JOIN f ON r.b = f.u),
s AS (SELECT x.a AS v, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), n AS (SELECT scc, count(*) AS n FROM s GROUP BY scc ORDER BY n DESC, scc LIMIT 1) SELECT v FROM s JOIN n ON s.scc = n.scc""")
def strong_part(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("v"))
    return C.strong_part(materialise(flows(spark, d), "flows"), nations)


@query(f"WITH {CHAINS}, m AS (SELECT max(v) // 20000 * 10000 + 3 AS first FROM t) SELECT eid, u, v, length FROM e, m WHERE e.v < m.first")
def peeled_ends(spark, d):
    """Edges at added nodes go from their ends; here nodes of the later conversations are the added ones."""
    e = chains(spark, d)
    first = table(spark, d, "conversations").agg(F.max(F.col("conv_id") * 10000 + F.col("turn"))).first()[0] // 20000 * 10000 + 3
    return roads.peel_new(e, int(first)).select("eid", "u", "v", "length")


@query(f"""WITH {FLOWS}, k AS (SELECT CAST(n_nationkey AS BIGINT) AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS new FROM nation WHERE n_nationkey % 4 <> 1)
SELECT f.u * 100 + f.v AS eid, CAST(a.new AS BIGINT) AS u, CAST(b.new AS BIGINT) AS v FROM f JOIN k a ON a.id = f.u JOIN k b ON b.id = f.v""")
def induced_subgraph(spark, d):
    """Edges of which both ends stay, with the remaining nodes numbered anew."""
    nodes = table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").cast("long").alias("id"))
    return roads.relabelled(nodes, flows(spark, d))[1].select("eid", "u", "v")


@query(f"""WITH RECURSIVE {PIXELS}, n AS (SELECT a.key AS a, b.key AS b FROM px a JOIN px b ON a.key <> b.key AND abs(a.key // 256 - b.key // 256) <= 1 AND abs(a.key % 256 - b.key % 256) <= 1),
r(a, b) AS (SELECT key, key FROM px UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), c AS (SELECT a AS key, min(b) AS comp FROM r GROUP BY a)
SELECT key, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS BIGINT) AS rank FROM c""")
def component_ranks(spark, d):
    """Components of pixels numbered by their first pixels."""
    keys = pixels(spark, d)
    near = corridor.neighbours(keys, 256).select(F.col("key").alias("u"), F.col("other").alias("v"))
    return C.ranked(C.components(near, keys.withColumnRenamed("key", "v"))).select(F.col("v").alias("key"), "rank")


@query(f"""WITH {POINTS}, c AS (SELECT a.id AS osm, b.id AS id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM pts a JOIN pts b ON a.label <> b.label AND b.label = 0), n AS (SELECT osm, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM c GROUP BY osm)
SELECT osm, CASE WHEN distance <= 0.02 THEN 'snap' WHEN distance <= 0.06 THEN 'connect' ELSE 'new' END AS action, CASE WHEN distance <= 0.06 THEN id ELSE -1 END AS id FROM n""")
def attached_ends(spark, d):
    """Ends that become the nearest junction, are tied to it, or stand alone."""
    p = points(spark, d)
    return links.attach_ends(p.where("label <> 0").select(F.col("id").alias("osm"), "x", "y"), p.where("label = 0").select("id", "x", "y"), LinkParams(snap_m=0.02, connect_m=0.06)).select("osm", "action", F.coalesce("id", F.lit(-1)).alias("id"))


def _meets(a: str, b: str) -> str:
    """SQL: whether two segments have any point in common."""
    on = lambda p, q, r: f"({_turn(p, q, r)} = 0 AND {r}x BETWEEN least({p}x, {q}x) AND greatest({p}x, {q}x) AND {r}y BETWEEN least({p}y, {q}y) AND greatest({p}y, {q}y))"
    p, q, r, s = f"{a}.a", f"{a}.b", f"{b}.a", f"{b}.b"
    proper = f"({_turn(p, q, r)} * {_turn(p, q, s)} < 0 AND {_turn(r, s, p)} * {_turn(r, s, q)} < 0)"
    return f"({proper} OR {on(p, q, r)} OR {on(p, q, s)} OR {on(r, s, p)} OR {on(r, s, q)})"


_WALLS = """w AS (SELECT c_custkey AS k, CAST(c_custkey % 40 AS DOUBLE) AS ax, CAST(c_nationkey AS DOUBLE) AS ay, CAST(c_custkey % 40 + c_custkey % 3 AS DOUBLE) AS bx, CAST(c_nationkey + c_custkey % 2 AS DOUBLE) AS "by" FROM customer WHERE c_custkey % 9 = 0),
q AS (SELECT s_suppkey AS k, CAST(s_suppkey % 37 AS DOUBLE) AS ax, CAST(s_nationkey AS DOUBLE) AS ay, CAST(s_suppkey % 37 + s_suppkey % 4 AS DOUBLE) AS bx, s_nationkey + 0.5 AS "by" FROM supplier)"""


@query(f'WITH {_WALLS} SELECT q.k FROM q WHERE NOT EXISTS (SELECT 1 FROM w WHERE {_meets("q", "w")})')
def barrier_anti_join(spark, d):
    """Links that touch no barrier, not even at an end; on whole coordinates most meetings are touches."""
    n = lambda c, *v: table(spark, d, c).select(*(x.cast("double").alias(a) for x, a in zip(v[1:], ("ax", "ay", "bx", "by"), strict=True)), v[0].alias("k"))
    c, s = F.col, F.col
    walls = n("customer", c("c_custkey"), c("c_custkey") % 40, c("c_nationkey"), c("c_custkey") % 40 + c("c_custkey") % 3, c("c_nationkey") + c("c_custkey") % 2).where("k % 9 = 0")
    cut = n("supplier", s("s_suppkey"), s("s_suppkey") % 37, s("s_nationkey"), s("s_suppkey") % 37 + s("s_suppkey") % 4, s("s_nationkey") + 0.5)
    return grid.without_meeting(cut, walls, L.intersects, 4.0, "k").select("k")


@query(f"""WITH {nation_segments("supplier", "s")}, {nation_segments("customer", "c")}, m AS (SELECT s.eid, s.k, (s.ax + s.bx) / 2 AS x, (s.ay + s."by") / 2 AS y FROM s),
g AS (SELECT m.eid, m.k, c.eid AS face, least(1, greatest(0, coalesce(((m.x - c.ax) * (c.bx - c.ax) + (m.y - c.ay) * (c."by" - c.ay)) / nullif((c.bx - c.ax) * (c.bx - c.ax) + (c."by" - c.ay) * (c."by" - c.ay), 0), 0))) AS t, m.x, m.y, c.ax, c.ay, c.bx, c."by" FROM m, c)
SELECT eid, k, 'N' || arg_min(face, (round(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * ("by" - ay), 2)), 9), face)) AS name FROM g GROUP BY eid, k""")
def edge_names(spark, d):
    """Names of the nearest lines, to the middles of all edges."""
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    x, y = (F.col("s_suppkey") % 97).cast("double"), F.col("s_acctbal") / 100
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("eid"), F.col("s_suppkey").alias("k"), x.alias("x"), y.alias("y"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by"))
    edges = rows.where("bx is not null").select(F.struct("eid", "k").alias("eid"), F.array(F.struct("x", "y"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).alias("line"), F.lit(False).alias("bridged"))
    faces = nation_lines(spark, d, "customer").select(F.col("eid").alias("face_id"), F.concat(F.lit("N"), "eid").alias("name"), "line")
    return name_edges(edges, faces, 2.0).select("eid.eid", "eid.k", "name")


# --- corridors and pixels --------------------------------------------------------------------------------------------


_PIXEL_GRAPH = f"""{PIXELS}, n AS (SELECT a.key AS a, b.key AS b FROM px a JOIN px b ON a.key <> b.key AND abs(a.key // 256 - b.key // 256) <= 1 AND abs(a.key % 256 - b.key % 256) <= 1),
g AS (SELECT px.key, count(n.b) AS n FROM px LEFT JOIN n ON n.a = px.key GROUP BY px.key),
r(a, b) AS (SELECT key, key FROM px UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), c AS (SELECT a AS key, min(b) AS comp FROM r GROUP BY a),
ring AS (SELECT comp AS key FROM c JOIN g USING (key) GROUP BY comp HAVING bool_and(n = 2)),
nd AS (SELECT key FROM g WHERE n <> 2 UNION SELECT key FROM ring),
q(a, b) AS (SELECT key, key FROM nd UNION SELECT q.a, n.b FROM q JOIN n ON q.b = n.a JOIN nd ON nd.key = n.b), blob AS (SELECT a AS key, min(b) AS blob FROM q GROUP BY a),
inner_ AS (SELECT key FROM px EXCEPT SELECT key FROM nd),
h(a, b) AS (SELECT key, key FROM inner_ UNION SELECT h.a, n.b FROM h JOIN n ON h.b = n.a JOIN inner_ ON inner_.key = n.b), chain AS (SELECT a AS key, min(b) AS chain FROM h GROUP BY a)"""


@query(f"WITH RECURSIVE {_PIXEL_GRAPH} SELECT blob AS id, avg(key // 256) AS row, avg(key % 256) AS col FROM blob GROUP BY blob")
def pixel_graph_nodes(spark, d):
    """Nodes of a pixel image: all pixels without just two neighbours, touching ones together, and one of each ring."""
    return corridor.pixel_graph(pixels(spark, d), 256)[0].select("id", F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"))


@query(f"""WITH RECURSIVE {_PIXEL_GRAPH}, ends AS (SELECT chain, n.b AS o, n.a AS k, blob FROM chain JOIN n ON n.a = chain.key JOIN blob ON blob.key = n.b),
two AS (SELECT chain, arg_min(blob, (o, k)) AS u, arg_max(blob, (o, k)) AS v FROM ends GROUP BY chain), size AS (SELECT chain, count(*) AS n FROM chain GROUP BY chain)
SELECT chain AS eid, u, v, CAST(n + 2 AS BIGINT) AS pixels FROM two JOIN size USING (chain) WHERE NOT (n = 1 AND u = v)""")
def pixel_graph_edges(spark, d):
    """Edges of a pixel image: chains of pixels between nodes, with both end pixels."""
    return corridor.pixel_graph(pixels(spark, d), 256)[1].select("eid", "u", "v", F.size("path").cast("long").alias("pixels"))


def _block(spark, d) -> DataFrame:
    """Bent lines, one for each region, 60 m apart."""
    k = F.col("r_regionkey")
    line = F.array(_point(k * 60 + 0.25, 0.0), _point(k * 60 + 40.5, k * 7), _point(k * 60 + 20.0, 30 + k))
    return table(spark, d, "region").select(k.cast("long").alias("face_id"), line.alias("line"))


_BURN = """reg AS (SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region),
seg AS (SELECT k * 60 + 0.25e0 AS ax, 0e0 AS ay, k * 60 + 40.5e0 AS bx, k * 7 AS "by" FROM reg UNION ALL SELECT k * 60 + 40.5e0, k * 7, k * 60 + 20, 30 + k FROM reg),
jo AS (SELECT k * 60 + 40.5e0 AS jx, k * 7 AS jy FROM reg),
geo AS (SELECT x0 - 24 AS x0, y1 + 24 AS y0, CAST(ceil((x1 - x0 + 48) / 2) AS BIGINT) AS width, CAST(ceil((y1 - y0 + 48) / 2) AS BIGINT) AS height FROM (SELECT min(least(ax, bx)) AS x0, max(greatest(ax, bx)) AS x1, min(least(ay, "by")) AS y0, max(greatest(ay, "by")) AS y1 FROM seg)),
pix AS (SELECT r * width + c AS key, r, c, x0 + (c + 0.5) * 2 AS px, y0 - (r + 0.5) * 2 AS py, width, height FROM geo, (SELECT unnest(range(0, 400)) AS r), (SELECT unnest(range(0, 400)) AS c) WHERE r < height AND c < width),
hit AS (
  SELECT DISTINCT key FROM pix JOIN (SELECT *, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS n FROM seg) s
    ON ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / n BETWEEN 0 AND n AND abs((px - ax) * ("by" - ay) - (py - ay) * (bx - ax)) / n <= 6
  UNION SELECT key FROM pix JOIN jo ON (px - jx) * (px - jx) + (py - jy) * (py - jy) <= 36)"""
_SMALL = CorridorParams(half_width_m=6.0, tile_m=90.0, tile_margin_m=40.0)


@query(f"WITH {_BURN} SELECT key FROM hit")
def corridor_pixels(spark, d):
    """Pixels within half a street's width of lines, drawn in tiles."""
    return corridor.skeleton(_block(spark, d), _SMALL, upto="burn")[0]


_CLOSE = """grown AS (SELECT DISTINCT p.key FROM hit h JOIN pix q ON q.key = h.key JOIN pix p ON abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1),
closed AS (SELECT p.key FROM pix p JOIN grown USING (key) WHERE (SELECT count(*) FROM grown g JOIN pix q ON q.key = g.key WHERE abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1) = 9)"""


@query(f"WITH {_BURN}, {_CLOSE} SELECT key FROM closed")
def closed_pixels(spark, d):
    """The same after closing: grown by a pixel and shrunk again."""
    return corridor.skeleton(_block(spark, d), _SMALL, upto="close")[0]


@query(f"""WITH RECURSIVE {_BURN}, {_CLOSE}, empty AS (SELECT key, r, c FROM pix WHERE key NOT IN (SELECT key FROM closed)),
edge AS (SELECT a.key AS a, b.key AS b FROM empty a JOIN empty b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
o(key) AS (SELECT min(key) FROM empty UNION SELECT edge.b FROM o JOIN edge ON edge.a = o.key),
rest AS (SELECT key FROM empty EXCEPT SELECT key FROM o),
w(a, b) AS (SELECT key, key FROM rest UNION SELECT w.a, edge.b FROM w JOIN edge ON edge.a = w.b),
hole AS (SELECT a AS key FROM w GROUP BY a HAVING count(*) <= 81) SELECT key FROM closed UNION SELECT key FROM hole""")
def filled_pixels(spark, d):
    """The same with small holes filled."""
    return corridor.skeleton(_block(spark, d), _SMALL, upto="fill")[0]


@query("SELECT CAST(k AS BIGINT) AS id, 100 + (c + 0.5e0) * 2 AS x, 900 - (r + 0.5e0) * 2 AS y, k % 3 > 0 AS kept FROM (SELECT s_suppkey AS k, CAST(s_suppkey % 50 AS DOUBLE) AS r, s_suppkey % 20 + 0.5e0 AS c FROM supplier)")
def pixel_metres(spark, d):
    """Pixel places in metres, and edges without those of length zero."""
    k = F.col("s_suppkey")
    nodes = materialise(table(spark, d, "supplier").select(k.cast("long").alias("id"), (k % 50).cast("double").alias("row"), (k % 20 + 0.5).alias("col")), "pixel-nodes")
    edges = nodes.select(F.col("id").alias("eid"), F.col("id").alias("u"), F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, F.array(F.lit(5), F.lit(70))).otherwise(F.array(F.lit(5), F.lit(5))).cast("array<bigint>").alias("path"))
    geo = spark.range(1).select(F.lit(100.0).alias("x0"), F.lit(900.0).alias("y0"), F.lit(64).cast("long").alias("width"))
    metres, lines = corridor.street_graph(nodes, edges, geo, CorridorParams())
    return metres.join(lines.select(F.col("eid").alias("id"), F.lit(True).alias("kept")), "id", "left").select("id", "x", "y", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""SELECT true AS one_part, true AS named, true AS dense, true AS straight, CAST(4 AS BIGINT) AS most, true AS long""")
def graph_checks(spark, d):
    """What the graph of a regular town must be: one part, named by its faces, with dense ids, and no more than crossings."""
    from .build import build_graph

    nodes, edges = build_graph(town(spark, d), CorridorParams(min_component_km=0.1, tile_m=400.0, tile_margin_m=60.0))
    nodes, edges = materialise(nodes, "town-nodes"), materialise(edges, "town-edges")
    most = roads.degrees(edges).agg(F.max("degree").alias("most"))
    n = nodes.agg((F.count("*") == F.max("id") + 1).alias("dense"))
    parts = C.components(edges.select("u", "v")).agg((F.count_distinct("comp") == 1).alias("one_part"))
    # Six streets of about 510 m run in each direction between and around the 5 x 5 blocks.
    e = edges.agg(F.bool_and(F.col("bridged") | F.startswith("name", F.lit("Rua "))).alias("named"), F.bool_and(F.size("line") >= 2).alias("straight"), F.sum("length").between(5500, 6800).alias("long"))
    return parts.crossJoin(e).crossJoin(n).crossJoin(most).select("one_part", "named", "dense", "straight", "most", "long")  # a row each


# --- links and directions --------------------------------------------------------------------------------------------


_GAP = "(SELECT s_suppkey AS k, s_acctbal, s_suppkey % 2 = 0 AS wall, s_suppkey % 3 = 0 AS short FROM supplier)"


@query(f"SELECT CAST(k * 4 AS BIGINT) AS u, CAST(k * 4 + 2 AS BIGINT) AS v, 40e0 AS length FROM {_GAP} WHERE NOT wall AND NOT short UNION ALL SELECT CAST(k * 4 + 1 AS BIGINT), CAST(k * 4 + 3 AS BIGINT), 40e0 FROM {_GAP} WHERE NOT short AND wall")
def detour_links(spark, d):
    """Two streets 40 m apart for each supplier. Without a wall their west ends are linked, which makes the way between the
    east ends short enough; a wall stands between the west ends, so then the east ends are linked; where a road joins the
    streets already, nothing is."""
    k = F.col("s_suppkey").cast("long")
    s = table(spark, d, "supplier").select(k.alias("k"), (k * 100_000).cast("double").alias("y"))
    ends = F.array(*(F.struct((F.col("k") * 4 + i).alias("id"), F.lit(x).alias("x"), (F.col("y") + y).alias("y")) for i, (x, y) in enumerate(((0.0, 0.0), (150.0, 0.0), (0.0, 40.0), (150.0, 40.0)))))
    nodes = materialise(s.select(F.inline(ends)), "gap-nodes")
    edge = lambda n, u, v, length, line: F.struct((F.col("k") * 3 + n).alias("eid"), (F.col("k") * 4 + u).alias("u"), (F.col("k") * 4 + v).alias("v"), F.lit(length).alias("length"), line.alias("line"), F.lit(False).alias("bridged"))
    street = lambda y: F.array(_point(0.0, F.col("y") + y), _point(150.0, F.col("y") + y))
    round_ = F.array(_point(0.0, F.col("y")), _point(-30.0, F.col("y") + 20), _point(0.0, F.col("y") + 40))
    edges = s.select(F.inline(F.array(edge(0, 0, 1, 150.0, street(0)), edge(1, 2, 3, 150.0, street(40)))))
    edges = materialise(edges.union(s.where("k % 3 = 0").select(F.inline(F.array(edge(2, 0, 2, 72.0, round_))))), "gap-edges")
    walls = s.where("k % 2 = 0").select(F.lit(-10.0).alias("ax"), (F.col("y") + 20).alias("ay"), F.lit(10.0).alias("bx"), (F.col("y") + 20).alias("by"))
    return detours.link_detours(nodes, edges, walls, 100.0, 10.0).select("u", "v", "length")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m FROM supplier),
e AS (SELECT k, 0 AS n, '' AS name, 100e0 AS length, false AS bridged, false AS oneway FROM s UNION ALL SELECT k, 1, '', 100.0, false, false FROM s WHERE m = 1
  UNION ALL SELECT k, 2, 'R' || k, 855.0, false, false FROM s WHERE m = 1 UNION ALL SELECT k, 3, '', 40.0, true, false FROM s WHERE m = 1)
SELECT CAST(count(*) AS BIGINT) AS edges, round(sum(length), 6) AS length, CAST(count(*) FILTER (bridged) AS BIGINT) AS bridged, max(name) AS name FROM e WHERE k = (SELECT min(k) FROM s WHERE m = 1) """)
def connected_roads(spark, d):
    """Two streets for each supplier, joined in every third place by a main road that ends beside a junction (it becomes
    that junction) and 40 m from another (a connector); a small street joins nothing, and a road along a street is no new
    one. The largest part that stays is one of those joined, the first by its numbers."""
    k = F.col("s_suppkey").cast("long")
    s = table(spark, d, "supplier").select(k.alias("k"), (k * 10_000).cast("double").alias("y"))
    xs = (0.0, 100.0, 1000.0, 1100.0)
    nodes = materialise(s.select(F.inline(F.array(*(F.struct((F.col("k") * 4 + i).alias("id"), F.lit(x).alias("x"), F.col("y").alias("y")) for i, x in enumerate(xs))))), "road-nodes")
    edge = lambda n: F.struct((F.col("k") * 2 + n).alias("eid"), (F.col("k") * 4 + 2 * n).alias("u"), (F.col("k") * 4 + 2 * n + 1).alias("v"), F.lit(100.0).alias("length"), F.array(_point(xs[2 * n], F.col("y")), _point(xs[2 * n + 1], F.col("y"))).alias("line"), F.lit(False).alias("bridged"), F.lit(False).alias("oneway"), F.lit("").alias("name"))
    edges = materialise(s.select(F.inline(F.array(edge(0), edge(1)))), "road-edges")
    main = F.array(_point(105.0, F.col("y")), _point(960.0, F.col("y")))
    way = lambda n, cls, line: F.struct((F.col("k") * 3 + n).alias("way_id"), F.create_map(F.lit("highway"), F.lit(cls), F.lit("ref"), F.concat(F.lit("R"), "k")).alias("tags"), F.array(F.col("k") * 10 + 2 * n, F.col("k") * 10 + 2 * n + 1).alias("nodes"), line.alias("line"))
    along = F.array(_point(0.0, F.col("y") + 3), _point(100.0, F.col("y") + 3))
    ways = s.where("k % 3 = 1").select(F.inline(F.array(way(0, "primary", main), way(2, "secondary", along)))).union(s.where("k % 3 = 2").select(F.inline(F.array(way(1, "residential", main)))))
    _, found = links.connect(nodes, edges, materialise(ways, "road-ways"))
    return found.agg(F.count("*").alias("edges"), F.round(F.sum("length"), 6).alias("length"), F.count_if("bridged").alias("bridged"), F.max("name").alias("name"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS way_id, s_suppkey % 2 = 0 AS legacy FROM supplier WHERE s_suppkey % 5 <> 0 AND (s_suppkey % 2 = 1 OR s_suppkey % 4 = 2)""")
def way_filters(spark, d):
    """Segments that count in matching: points are none, and by an older rule neither are those short beside their place."""
    k = F.col("s_suppkey")
    size = F.when(k % 5 == 0, 0.0).when(k % 4 == 2, 90.0).otherwise(60.0)
    w = table(spark, d, "supplier").select(k.cast("long").alias("way_id"), F.array(_point(500_000.0, 7_400_000.0), _point(500_000.0, 7_400_000.0 + size)).alias("line"))
    old = oneway.way_segments(w.where("way_id % 2 = 0"), MatchParams(legacy_degenerate=True), "way_id")
    return old.select("way_id", F.lit(True).alias("legacy")).unionByName(oneway.way_segments(w.where("way_id % 2 = 1"), MatchParams(), "way_id").select("way_id", F.lit(False).alias("legacy")))


@query("SELECT CAST(s_suppkey AS BIGINT) AS eid, CAST(CASE WHEN s_suppkey % 7 = 3 THEN -1 ELSE 1 END AS INTEGER) AS direction FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey % 5 <> 2")
def match_filters(spark, d):
    """A way beside every street; estimated links and streets shorter than a metre take no part."""
    k = F.col("s_suppkey")
    size = F.when(k % 5 == 2, 0.5).otherwise(80.0)
    edges = table(spark, d, "supplier").select(k.cast("long").alias("eid"), F.array(_point(0.0, k * 100), _point(size, k * 100)).alias("line"), (k % 4 == 1).alias("bridged"))
    line = F.array(_point(-5.0, k * 100 + 3), _point(90.0, k * 100 + 3))
    ways = table(spark, d, "supplier").select(k.alias("way_id"), F.when(k % 7 == 3, F.reverse(line)).otherwise(line).alias("line"))
    return oneway.match_directions(edges, ways)


def _squares(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two streets between two nodes for each supplier, both with a one-way way: a circle, but in every third place both
    ways run to the same node."""
    k = F.col("s_suppkey").cast("long")
    s = table(spark, d, "supplier").select(k.alias("k"), (k * 1000).cast("double").alias("y"))
    edge = lambda n: F.struct((F.col("k") * 2 + n).alias("eid"), (F.col("k") * 2).alias("u"), (F.col("k") * 2 + 1).alias("v"), F.array(_point(0.0, F.col("y") + 60 * n), _point(200.0, F.col("y") + 60 * n)).alias("line"), F.lit(False).alias("bridged"))
    way = lambda n: F.array(_point(0.0, F.col("y") + 60 * n + 2), _point(200.0, F.col("y") + 60 * n + 2))
    ways = s.select((F.col("k") * 2).alias("way_id"), way(0).alias("line")).union(s.select((F.col("k") * 2 + 1).alias("way_id"), F.when(F.col("k") % 3 == 0, way(1)).otherwise(F.reverse(way(1))).alias("line")))
    return materialise(s.select(F.inline(F.array(edge(0), edge(1)))), "squares"), materialise(ways, "square-ways")


@query("""SELECT CAST(2 * s_suppkey AS BIGINT) AS eid, CAST(2 * s_suppkey AS BIGINT) AS u, CAST(2 * s_suppkey + 1 AS BIGINT) AS v, s_suppkey % 3 <> 0 AS oneway, 0e0 AS x FROM supplier
UNION ALL SELECT CAST(2 * s_suppkey + 1 AS BIGINT), CAST(2 * s_suppkey + CASE WHEN s_suppkey % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT), CAST(2 * s_suppkey + CASE WHEN s_suppkey % 3 <> 0 THEN 0 ELSE 1 END AS BIGINT), s_suppkey % 3 <> 0, CASE WHEN s_suppkey % 3 <> 0 THEN 200e0 ELSE 0e0 END FROM supplier""")
def oneway_assignment(spark, d):
    """Directions kept where all can still be reached, with ends and lines turned; others are opened again."""
    edges, ways = _squares(spark, d)
    return oneway.assign_oneway(edges, ways).select("eid", "u", "v", "oneway", F.col("line")[0]["x"].alias("x"))


@query("SELECT CAST(2 * count(*) AS BIGINT) AS matched, CAST(2 * count(*) FILTER (s_suppkey % 3 <> 0) AS BIGINT) AS kept, CAST(2 * count(*) FILTER (s_suppkey % 3 = 0) AS BIGINT) AS reverted FROM supplier")
def oneway_counts(spark, d):
    edges, ways = _squares(spark, d)
    return oneway.oneway_summary(oneway.match_directions(edges, ways), oneway.assign_oneway(edges, ways))


# --- path finders ----------------------------------------------------------------------------------------------------


def _line_graph(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations on a line, with side roads to nowhere: between two of them there is one way only."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    area = F.lit("a").alias("area")
    nodes = n.select(area, F.col("k").alias("id"), (F.col("k") * 10.0).alias("x"), F.lit(0.0).alias("y")).union(n.select(area, F.col("k") + 100, F.col("k") * 10.0, F.lit(5.0)))
    edges = n.where("k > 0").select(area, (F.col("k") - 1).alias("u"), F.col("k").alias("v"), (F.col("k") % 4 + 10.0).alias("length")).union(n.select(area, F.col("k"), F.col("k") + 100, F.lit(5.0)))
    pairs = n.where("k >= 20").select(area, F.col("k").alias("pair"), (F.col("k") - 17).alias("a"), F.col("k").alias("b"))
    return nodes, edges, pairs


@query("""WITH p AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey >= 20), c AS (SELECT p.k, sum(n_nationkey % 4 + 10.0) AS cost, count(*) + 1 AS n FROM p JOIN nation ON n_nationkey > p.k - 17 AND n_nationkey <= p.k GROUP BY p.k)
SELECT algo, CAST(k AS BIGINT) AS pair, CAST(cost AS DOUBLE) AS cost, CAST(n AS BIGINT) AS nodes FROM c, (SELECT unnest(['dijkstra', 'astar', 'bidirectional', 'contraction', 'alt', 'greedy', 'beam', 'ant_colony', 'genetic', 'annealing', 'particle_swarm', 'nsga2']) AS algo)""")
def finder_costs(spark, d):
    """All finders where there is just one way: they must find it, at its cost."""
    runs = routing.run_finders(*_line_graph(spark, d), sorted(routing.FINDERS), parts=2)
    return runs.select("algo", "pair", "cost", F.size("path").cast("long").alias("nodes"))


@query("SELECT algo, 1e0 AS success, 0e0 AS gap, true AS counted FROM (SELECT unnest(['astar', 'bidirectional', 'contraction', 'dijkstra']) AS algo)")
def finder_metrics(spark, d):
    """Success, gap to the best and numbers of expanded nodes of exact finders."""
    runs = routing.run_finders(*_line_graph(spark, d), ["astar", "bidirectional", "contraction", "dijkstra"], parts=1)
    return routing.metrics(runs).select("algo", "success", F.round("gap", 9).alias("gap"), (F.col("expanded") > 0).alias("counted"))


@query("""WITH s AS (SELECT c_nationkey AS b, c_mktsegment AS m, round(avg(c_acctbal), 2) AS v FROM customer GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2.0 AS rank FROM s),
k AS (SELECT count(DISTINCT m) AS k FROM s), f AS (SELECT * FROM r WHERE b IN (SELECT b FROM s GROUP BY b HAVING count(*) = (SELECT k FROM k))), a AS (SELECT m, avg(rank) AS r, count(*) AS n FROM f GROUP BY m)
SELECT CAST(max(n) AS BIGINT) AS n, CAST((SELECT k FROM k) AS INTEGER) AS k, round(12.0 * max(n) / ((SELECT k FROM k) * ((SELECT k FROM k) + 1)) * (sum(r * r) - (SELECT k FROM k) * pow((SELECT k FROM k) + 1, 2) / 4), 6) AS chi2, round(2.728 * sqrt((SELECT k FROM k) * ((SELECT k FROM k) + 1) / (6.0 * max(n))), 6) AS cd FROM a""")
def friedman_test(spark, d):
    scores = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("b"), F.col("c_mktsegment").alias("m")).agg(F.round(F.avg("c_acctbal"), 2).alias("v"))
    return routing.friedman(scores, "b", "m", "v").select("n", "k", F.round("chi2", 6).alias("chi2"), F.round("critical_difference", 6).alias("cd"))


@query("""WITH g AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 8), p AS (SELECT abs(b.k - a.k) * 10e0 AS l, CASE WHEN (a.k < 4) = (b.k < 4) THEN abs(b.k - a.k) * 11e0 END AS m FROM g a JOIN g b ON a.k <> b.k),
s AS (SELECT 1 - avg(coalesce(least(1, abs(l - m) / l), 1)) AS f, 10e0 / 11 AS b FROM p) SELECT round(f, 9) AS forward, round(b, 9) AS backward, round(2 * f * b / (f + b), 9) AS apls FROM s""")
def path_similarity(spark, d):
    """How alike paths are in a graph and in another one that is a tenth longer and lacks an edge."""
    n = table(spark, d, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("k"))
    nodes = n.select(F.col("k").alias("id"), (F.col("k") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    other = nodes.select((F.col("id") + 500).alias("id"), "x", F.lit(0.5).alias("y"))
    edges = n.where("k > 0").select((F.col("k") - 1).alias("u"), F.col("k").alias("v"), F.lit(10.0).alias("length"))
    changed = edges.where("v <> 4").select((F.col("u") + 500).alias("u"), (F.col("v") + 500).alias("v"), F.lit(11.0).alias("length"))
    return routing.path_similarity(nodes, edges, other, changed, 1000.0, 2.0).select(*(F.round(c, 9).alias(c) for c in ("forward", "backward", "apls")))


@query(f"""WITH RECURSIVE {CHAINS}, b AS (SELECT u AS a, v AS b, length FROM e UNION ALL SELECT v, u, length FROM e), s AS (SELECT v FROM t WHERE turn = 1),
r(source, v, cost) AS (SELECT v, v, CAST(0 AS DOUBLE) FROM s UNION SELECT r.source, b.b, r.cost + b.length FROM r JOIN b ON r.v = b.a WHERE r.cost + b.length <= 10 * greatest(10, r.source // 10000 % 7 * 30))
SELECT source, v, min(cost) AS cost FROM r GROUP BY source, v""")
def detour_reach(spark, d):
    """What lies within the largest detour of each source, which depends on its gaps."""
    turns = table(spark, d, "conversations").where("turn = 1").select((F.col("conv_id") * 10000 + F.col("turn")).cast("long").alias("v"))
    gaps = turns.select(F.col("v").alias("u"), F.explode(F.array(F.lit(0.0), F.floor(F.col("v") / 10000) % 7 * 30.0)).alias("gap"))
    return routing.bounded_distances(chains(spark, d), detours.reaches(gaps, 10.0).withColumnRenamed("u", "v"), None)
