"""Named queries over the driver's tables, each with the SQL that checks it.

The tables hold no streets, so operators are shown on stand-ins: embeddings are points, customers and suppliers of a nation
are the points of a polyline, conversations are chains, line items are a multigraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CorridorParams, LinkParams, MatchParams
from ..functions import lines as L
from ..functions import projection as P
from ..functions import text as T
from ..operators import components as C
from ..operators import corridor, grid, links, oneway, roads, routing
from ..sinks import documents as sink
from ..sources import documents as source
from ..tables import materialise, table
from .build import build_graph

# --- stand-ins -------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


POINTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"


def _line(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    sorted_points = F.array_sort(F.collect_list(F.struct(*order, "x", "y")))
    return rows.groupBy(key).agg(F.transform(sorted_points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def user_lines(spark: SparkSession, d: str) -> DataFrame:
    """A polyline per user: hours and values of their events in order of time."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000.0
    return _line(table(spark, d, "events").select("user_id", "ts", "event_id", hours.alias("x"), F.col("value").alias("y")), "user_id", ["ts", "event_id"])


USER_POINTS = """ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS x, value AS y FROM events),
seg AS (SELECT * FROM (SELECT user_id, i AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS "by" FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE bx IS NOT NULL),
len AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - "by") * (ay - "by")) AS len FROM seg)"""


def nation_lines(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A polyline per nation: balances of its customers or suppliers in order of their keys."""
    c = name[0]
    rows = table(spark, d, name).select(F.col(f"{c}_nationkey").cast("long").alias("eid"), F.col(f"{c}_{name[:4]}key" if c == "c" else "s_suppkey").alias("k"), (F.col(f"{c}_acctbal") / 100).alias("y"))
    return _line(rows.withColumn("x", (F.col("k") % 97).cast("double")), "eid", ["k"])


def nation_segments(name: str, alias: str) -> str:
    c, k = ("c", "c_custkey") if name == "customer" else ("s", "s_suppkey")
    return f"""{alias} AS (SELECT * FROM (SELECT eid, k, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS "by" FROM (SELECT CAST({c}_nationkey AS BIGINT) AS eid, {k} AS k, CAST({k} % 97 AS DOUBLE) AS x, {c}_acctbal / 100 AS y FROM {name}) WINDOW w AS (PARTITION BY eid ORDER BY k)) WHERE bx IS NOT NULL)"""


def chains(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chains of turns: eid, u, v, length (characters of the later turn), line, bridged."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).cast("long").alias("v"), "conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("length"))
    before = F.lag("v").over(W.partitionBy("conv_id").orderBy("turn"))
    edges = rows.withColumn("u", before).where("u is not null")
    point = lambda c: F.struct(F.col(c).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return edges.select(F.col("v").alias("eid"), "u", "v", "length", F.array(point("u"), point("v")).alias("line"), F.lit(False).alias("bridged"))


CHAINS = """t AS (SELECT conv_id, turn, CAST(conv_id * 10000 + turn AS BIGINT) AS v, CAST(coalesce(length(text), 0) AS DOUBLE) AS length FROM conversations),
e AS (SELECT * FROM (SELECT conv_id, v AS eid, lag(v) OVER (PARTITION BY conv_id ORDER BY turn) AS u, v, length FROM t) WHERE u IS NOT NULL)"""


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges between nations: customer's to supplier's, where more was sold than on average: eid, u, v, oneway."""
    o, l = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    c, s = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    sold = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey).groupBy("c_nationkey", "s_nationkey").agg(F.sum("l_quantity").alias("q"))
    mean = sold.agg((1.3 * F.avg("q")).alias("mean"))
    high = sold.crossJoin(F.broadcast(mean)).where("q > mean and c_nationkey <> s_nationkey")  # mean is one row
    return high.select((F.col("c_nationkey") * 100 + F.col("s_nationkey")).cast("long").alias("eid"), F.col("c_nationkey").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("v"), F.lit(True).alias("oneway"))


FLOWS = """sold AS (SELECT CAST(c_nationkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS v, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
f AS (SELECT u, v FROM sold WHERE q > (SELECT 1.3 * avg(q) FROM sold) AND u <> v)"""


def town(spark: SparkSession, d: str) -> DataFrame:
    """Nations as blocks of 90 m between streets 12 m wide, five in a row: face_id, name and line, four faces a block."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("nm"))
    x, y = (F.col("k") % 5) * 102.0 + 500_000, F.floor(F.col("k") / 5) * 102.0 + 7_400_000
    corners = [(x, y), (x + 90, y), (x + 90, y + 90), (x, y + 90), (x, y)]
    p = [F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners]
    sides = F.array(*(F.array(p[i], p[i + 1]) for i in range(4)))
    return n.select("k", "nm", F.posexplode(sides).alias("i", "line")).select((F.col("k") * 4 + F.col("i")).alias("face_id"), T.street_name(F.lit("RUA"), F.lit(None).cast("string"), F.col("nm")).alias("name"), "line")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """A 256 x 256 image in which each customer sets a pixel."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(((k * k * 31 + k * 97 + F.col("c_nationkey") * 1009) % 65536).cast("long").alias("key")).distinct()


PIXELS = "px AS (SELECT DISTINCT CAST((c_custkey * c_custkey * 31 + c_custkey * 97 + c_nationkey * 1009) % 65536 AS BIGINT) AS key FROM customer)"

# --- queries ---------------------------------------------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def scan_dedupe_keep_first(spark, d):
    return source.keep_first(table(spark, d, "documents", "doc_id", "source"), "source", "doc_id").select("source", "doc_id")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type || ' ' || p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part")
def title_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.street_name(F.col("p_type"), F.lit("  "), F.upper("p_name")).alias("name"))


@query("""SELECT event_id, CASE WHEN k % 6 IN (0, 3) THEN 1 WHEN k % 6 = 1 THEN -1 WHEN k % 6 = 2 THEN 0 WHEN event_type = 'error' OR event_type = 'click' THEN 1 ELSE 0 END AS direction
FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""")
def tag_direction(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 6
    value = F.when(k == 0, "yes").when(k == 1, "-1").when(k == 2, "NO").when(k == 3, "True").when(k == 4, "reversible")
    tags = F.create_map(F.lit("oneway"), value, F.lit("junction"), F.when(F.col("event_type") == "error", "roundabout"), F.lit("highway"), F.when(F.col("event_type") == "click", "motorway").otherwise("primary"))
    return table(spark, d, "events").select("event_id", T.direction(tags).alias("direction"))


@query("SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def json_tags(spark, d):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(floor((-74 + (c_custkey % 400) / 10.0 + 180) / 6) + 1 AS INTEGER) AS zone, CAST(31960 + floor((-74 + (c_custkey % 400) / 10.0 + 180) / 6) + 1 AS INTEGER) AS epsg FROM customer")
def utm_zone(spark, d):
    zone = P.zone_of(-74 + (F.col("c_custkey") % 400) / 10)
    return table(spark, d, "customer").select("c_custkey", zone.alias("zone"), P.epsg_of(zone).alias("epsg"))


def _series(c: tuple, f: str, g: str, a: str, b: str) -> str:
    return " + ".join(f"({v!r}) * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, v in enumerate(c, 1))


@query(f"""WITH p AS (SELECT c_custkey, -74 + (c_custkey % 400) / 10.0 AS lon, -30 + (c_custkey % 250) / 10.0 AS lat FROM customer),
z AS (SELECT *, floor((lon + 180) / 6) + 1 AS zone FROM p),
r AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM z),
t AS (SELECT *, sinh(atanh(sin(phi)) - {P._Q!r} * atanh({P._Q!r} * sin(phi))) AS t FROM r),
k AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey, round({P.EASTING!r} + {P.K0 * P._RADIUS!r} * (eta + {_series(P._FORWARD, "cos", "sinh", "xi", "eta")}), 3) AS x,
  round({P.NORTHING!r} + {P.K0 * P._RADIUS!r} * (xi + {_series(P._FORWARD, "sin", "cosh", "xi", "eta")}), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM k""")
def project_utm(spark, d):
    """Forward, and back to where it came from."""
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (-74 + (c % 400) / 10).alias("lon"), (-30 + (c % 250) / 10).alias("lat"))
    zone = P.zone_of(F.col("lon"))
    x, y = P.forward(F.col("lon"), F.col("lat"), zone)
    rows = rows.select("c_custkey", zone.alias("zone"), x.alias("x"), y.alias("y"))
    lon, lat = P.inverse(F.col("x"), F.col("y"), F.col("zone"))
    return rows.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(round_even(l_quantity / 4 * 10, 0) AS BIGINT) AS dm FROM lineitem")
def quantise_length(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", L.quantised(F.col("l_quantity") / 4).alias("dm"))


@query(f"WITH {USER_POINTS} SELECT user_id, round(sum(len), 4) AS length, CAST(count(*) + 1 AS BIGINT) AS n FROM len GROUP BY user_id")
def polyline_length(spark, d):
    return user_lines(spark, d).select("user_id", F.round(L.length(F.col("line")), 4).alias("length"), F.size("line").cast("long").alias("n"))


@query(f"""WITH {USER_POINTS},
k AS (SELECT user_id, ax, ay, bx, "by", greatest(1, CAST(ceil(len / 5.0) AS BIGINT)) AS k FROM len),
p AS (SELECT user_id, ax + (bx - ax) * (j / CAST(k AS DOUBLE)) AS x, ay + ("by" - ay) * (j / CAST(k AS DOUBLE)) AS y FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM k) UNION ALL SELECT user_id, x, y FROM ev WHERE i = 0)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y FROM p GROUP BY user_id""")
def densify(spark, d):
    return L.densified(user_lines(spark, d), "user_id", 5.0).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"))


@query(f"""WITH {USER_POINTS},
c AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY seg) AS upto FROM len),
t AS (SELECT user_id, sum(len) AS total FROM len GROUP BY user_id),
n AS (SELECT user_id, total, greatest(2, CAST(floor(total / 50.0) AS BIGINT)) AS n FROM t),
s AS (SELECT user_id, n, i, total * (i + 0.5) / n AS spot FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
m AS (SELECT s.user_id, s.i, s.n, arg_min(struct_pack(x := ax + (bx - ax) * ((spot - (upto - len)) / len), y := ay + ("by" - ay) * ((spot - (upto - len)) / len)), seg) AS p FROM s JOIN c ON c.user_id = s.user_id AND c.upto >= s.spot AND c.len > 0 GROUP BY s.user_id, s.i, s.n)
SELECT user_id, CAST(i AS INTEGER) AS i, CAST(n AS INTEGER) AS n, round(p.x, 3) AS x, round(p.y, 3) AS y FROM m""")
def sample_line(spark, d):
    return L.samples(user_lines(spark, d), "user_id", 50.0).select("user_id", "i", "n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {POINTS} SELECT label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts GROUP BY label")
def bbox_by_group(spark, d):
    lines = points(spark, d).groupBy("label").agg(F.collect_list(F.struct("x", "y")).alias("line"))
    return lines.select("label", L.box(F.col("line")).alias("box")).select("label", "box.*")


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[2 * i + 1] AS DOUBLE), 5) + 0.0 AS lon, round(CAST(embedding[2 * i + 2] AS DOUBLE), 5) + 0.0 AS lat FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)")
def flat_payload(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(L.unflat(F.col("embedding"), ("lon", "lat"))).alias("i", "p"))
    return rows.select("vec_id", "i", (F.round(F.col("p.lon").cast("double"), 5) + 0.0).alias("lon"), (F.round(F.col("p.lat").cast("double"), 5) + 0.0).alias("lat"))


@query(f"WITH {POINTS} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS distance FROM pts a JOIN pts b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02")
def range_join(spark, d):
    return grid.pairs_within(points(spark, d), 0.02).select("a", "b", F.round("distance", 9).alias("distance"))


@query(f"""WITH {POINTS}, c AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM pts a JOIN pts b ON a.label <> b.label AND b.label = 0)
SELECT a, arg_min(b, (distance, b)) AS b, round(min(distance), 9) AS distance FROM c GROUP BY a""")
def nearest_join(spark, d):
    p = points(spark, d)
    near = grid.nearest(p.where("label <> 0").select(F.col("id").alias("a"), "x", "y"), p.where("label = 0").select(F.col("id").alias("b"), "x", "y"), 0.01, "a", "b")
    return near.select("a", "b", F.round("distance", 9).alias("distance"))


@query(f"""WITH {POINTS}, c AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM pts a JOIN pts b ON a.id <> b.id)
SELECT a, b, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM c WHERE distance <= 0.05) WHERE rank <= 4""")
def knn_join(spark, d):
    p = points(spark, d)
    # Five with the point itself, which is its own nearest unless another one lies on it.
    a, b = p.select(F.col("id").alias("a"), "x", "y"), p.select(F.col("id").alias("b"), "x", "y")
    near = grid.knn_within(a, b, 0.05, 5, "a", "b").where("a <> b")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where("rank <= 4").select("a", "b", "rank")


def _dense(alias: str, seg: str, step: float) -> str:
    return f"""{alias}_k AS (SELECT *, greatest(1, CAST(ceil(sqrt((ax - bx) * (ax - bx) + (ay - "by") * (ay - "by")) / {step}) AS BIGINT)) AS pieces FROM {seg}),
{alias} AS (SELECT eid, ax + (bx - ax) * (j / CAST(pieces AS DOUBLE)) AS x, ay + ("by" - ay) * (j / CAST(pieces AS DOUBLE)) AS y FROM (SELECT *, unnest(range(1, pieces + 1)) AS j FROM {alias}_k)
  UNION ALL SELECT eid, arg_min(ax, k), arg_min(ay, k) FROM {seg} GROUP BY eid)"""


@query(f"""WITH {nation_segments("supplier", "s")}, {nation_segments("customer", "c")}, {_dense("sp", "s", 5.0)}, {_dense("cp", "c", 5.0)},
cells AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy, x, y FROM cp),
n AS (SELECT row_number() OVER () AS r, * FROM sp),
hit AS (SELECT DISTINCT r FROM n JOIN cells b ON b.cx BETWEEN floor(n.x) - 1 AND floor(n.x) + 1 AND b.cy BETWEEN floor(n.y) - 1 AND floor(n.y) + 1 AND sqrt((n.x - b.x) * (n.x - b.x) + (n.y - b.y) * (n.y - b.y)) <= 1.0)
SELECT eid AS pid, round(avg(CASE WHEN hit.r IS NULL THEN 0 ELSE 1 END), 6) AS share FROM n LEFT JOIN hit ON n.r = hit.r GROUP BY eid""")
def coverage_share(spark, d):
    pieces = nation_lines(spark, d, "supplier").where("size(line) >= 2").withColumnRenamed("eid", "pid")
    return links.coverage(pieces, nation_lines(spark, d, "customer").where("size(line) >= 2"), LinkParams(cover_m=1.0, step_m=5.0)).select("pid", F.round("share", 6).alias("share"))


_TURN = "sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _turn(a: str, b: str, c: str) -> str:
    return _TURN.format(a=a, b=b, c=c)


@query(f"""WITH {nation_segments("supplier", "s")}, {nation_segments("customer", "c0")}, c AS (SELECT *, k < max(k) OVER (PARTITION BY eid) AS goes_on FROM c0),
m AS (SELECT s.eid, s.k, {_turn("s.a", "s.b", "c.a")} * {_turn("s.a", "s.b", "c.b")} < 0 AND {_turn("c.a", "c.b", "s.a")} * {_turn("c.a", "c.b", "s.b")} < 0 AS proper, goes_on AND {_turn("s.a", "s.b", "c.b")} = 0 AND pb > 0 AND pb < sq AS vertex,
    {_turn("s.a", "s.b", "c.a")} = 0 AND {_turn("s.a", "s.b", "c.b")} = 0 AND least(greatest(pa, pb), sq) > greatest(least(pa, pb), 0) AS along
  FROM s JOIN c ON c.eid = s.eid, LATERAL (SELECT (c.ax - s.ax) * (s.bx - s.ax) + (c.ay - s.ay) * (s."by" - s.ay) AS pa, (c.bx - s.ax) * (s.bx - s.ax) + (c."by" - s.ay) * (s."by" - s.ay) AS pb, (s.bx - s.ax) * (s.bx - s.ax) + (s."by" - s.ay) * (s."by" - s.ay) AS sq))
SELECT s.eid, s.k FROM s WHERE (s.eid, s.k) NOT IN (SELECT (eid, k) FROM m GROUP BY eid, k HAVING bool_or(proper OR vertex) AND NOT bool_or(along))""")
def crossing_anti_join(spark, d):
    """Segments of suppliers that do not cross the line of customers of the same nation, between its vertices or at one."""
    # Nations lie apart, so that only their own lines meet.
    apart = lambda name: nation_lines(spark, d, name).where("size(line) >= 2").withColumn("line", F.transform("line", lambda p: F.struct((p["x"] + F.col("eid") * 1024).alias("x"), p["y"].alias("y"))))
    keys = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("eid"), F.col("s_suppkey").alias("k"))
    numbered = keys.withColumn("seg", F.row_number().over(W.partitionBy("eid").orderBy("k")) - 1)
    s = L.segments(apart("supplier"), "eid").join(numbered, ["eid", "seg"]).withColumn("pair", F.struct("eid", "k"))
    return grid.without_crossing(s, apart("customer"), "eid", 25.0, "pair").select("eid", "k")


@query(f"""WITH {PIXELS}, n AS (SELECT a.key, b.key AS other FROM px a JOIN px b ON a.key <> b.key AND abs(a.key // 256 - b.key // 256) <= 1 AND abs(a.key % 256 - b.key % 256) <= 1)
SELECT px.key, CAST(count(n.other) AS BIGINT) AS n FROM px LEFT JOIN n ON px.key = n.key GROUP BY px.key""")
def pixel_neighbours(spark, d):
    keys = pixels(spark, d)
    near = corridor.neighbours(keys, 256).groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(near, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH RECURSIVE {PIXELS}, n AS (SELECT a.key AS a, b.key AS b FROM px a JOIN px b ON a.key <> b.key AND abs(a.key // 256 - b.key // 256) <= 1 AND abs(a.key % 256 - b.key % 256) <= 1),
r(a, b) AS (SELECT key, key FROM px UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a)
SELECT a AS key, min(b) AS comp FROM r GROUP BY a""")
def pixel_components(spark, d):
    keys = pixels(spark, d)
    near = corridor.neighbours(keys, 256).select(F.col("key").alias("u"), F.col("other").alias("v"))
    return C.components(near, keys.withColumnRenamed("key", "v")).select(F.col("v").alias("key"), "comp")


@query("SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT 100000000 + l_suppkey FROM lineitem) GROUP BY id")
def node_degree(spark, d):
    return roads.degrees(table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 100000000).alias("v")))


@query(f"WITH RECURSIVE {CHAINS}, b AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), r(a, b) AS (SELECT v, v FROM t UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a) SELECT a AS v, min(b) AS comp FROM r GROUP BY a")
def connected_components(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).cast("long").alias("v"))
    return C.components(chains(spark, d).select("u", "v"), turns)


@query(f"""WITH RECURSIVE {FLOWS}, r(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT r.a, f.v FROM r JOIN f ON r.b = f.u)
SELECT x.a AS v, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("v"))
    return C.strong_components(materialise(C.arcs(flows(spark, d)), "flows"), nations)


@query(f"WITH {CHAINS}, k AS (SELECT conv_id, min(v) AS lo, max(v) AS hi FROM e WHERE length >= 300 GROUP BY conv_id) SELECT e.eid, e.u, e.v, e.length FROM e JOIN k ON e.conv_id = k.conv_id AND e.v BETWEEN k.lo AND k.hi")
def spur_pruning(spark, d):
    """On a chain spurs are what lies outside its first and last long edge."""
    return roads.prune_spurs(chains(spark, d), 300.0).select("eid", "u", "v", "length")


STREETS = "st AS (SELECT s_suppkey AS eid, CAST(s_nationkey AS BIGINT) AS u, 100 + s_suppkey % 7 AS v, s_acctbal AS length FROM supplier)"


@query(f"""WITH RECURSIVE {STREETS}, n AS (SELECT DISTINCT id FROM (SELECT u AS id FROM st UNION ALL SELECT v FROM st)),
g AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM st UNION ALL SELECT v FROM st) GROUP BY id),
s AS (SELECT u, v FROM st JOIN g a ON a.id = u JOIN g b ON b.id = v WHERE length < 500 AND a.degree >= 3 AND b.degree >= 3),
b AS (SELECT u AS a, v AS b FROM s UNION SELECT v, u FROM s), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a),
c AS (SELECT a AS id, min(b) AS rep FROM r GROUP BY a)
SELECT rep AS id, round(avg(CAST(id % 11 AS DOUBLE)), 9) AS x, round(avg(CAST(id % 13 AS DOUBLE)), 9) AS y, CAST((SELECT count(*) FROM st JOIN c p ON st.u = p.id JOIN c q ON st.v = q.id WHERE p.rep <> q.rep AND (p.rep = c.rep OR q.rep = c.rep)) AS BIGINT) AS kept FROM c GROUP BY rep""")
def junction_merge(spark, d):
    edges = materialise(table(spark, d, "supplier").select(F.col("s_suppkey").alias("eid"), F.col("s_nationkey").cast("long").alias("u"), (F.col("s_suppkey") % 7 + 100).cast("long").alias("v"), F.col("s_acctbal").alias("length")), "streets")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"))
    merged, kept = roads.merge_junctions(nodes, edges, 500.0)
    n = roads.degrees(materialise(kept, "streets-kept"))
    return merged.join(n, "id", "left").select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.coalesce("degree", F.lit(0)).cast("long").alias("kept"))


@query(f"""WITH {CHAINS}, s AS (SELECT conv_id, sum(length) AS total FROM e GROUP BY conv_id), k AS (SELECT conv_id FROM s WHERE total >= 2500 OR ((SELECT max(total) FROM s) < 2500 AND conv_id = (SELECT conv_id FROM s ORDER BY total DESC, conv_id LIMIT 1)))
SELECT t.v AS id FROM t JOIN k ON t.conv_id = k.conv_id""")
def major_parts(spark, d):
    return roads.major_parts(chains(spark, d), 2.5)


@query(f"""WITH RECURSIVE {POINTS}, e AS (SELECT a.id AS u, b.id AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS gap FROM pts a JOIN pts b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05),
k AS (SELECT *, row_number() OVER (ORDER BY gap, u, v) AS n FROM e), b AS (SELECT n, u AS a, v AS b FROM k UNION ALL SELECT n, v, u FROM k),
r(n, goal, here) AS (SELECT n, v, u FROM k UNION SELECT r.n, r.goal, b.b FROM r JOIN b ON b.a = r.here AND b.n < r.n)
SELECT u, v, round(gap, 9) AS length FROM k WHERE n NOT IN (SELECT n FROM r WHERE here = goal)""")
def component_links(spark, d):
    """A minimum spanning forest of the points, of links up to 0.05."""
    p = points(spark, d).select("id", "x", "y")
    none = p.limit(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    return roads.link_components(p, none, 0.05).select("u", "v", F.round("length", 9).alias("length"))


@query(f"WITH {CHAINS} SELECT least(min(u), min(v)) AS a, greatest(max(u), max(v)) AS b, sum(length) AS length, CAST(count(*) + 1 AS BIGINT) AS n FROM e GROUP BY conv_id")
def degree_two_merge(spark, d):
    merged = roads.contract_chains(chains(spark, d))
    return merged.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "length", F.size("line").cast("long").alias("n"))


@query("""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) ELSE 1000000000 + event_id END AS node FROM events),
u AS (SELECT node, count(*) AS uses FROM n GROUP BY node),
c AS (SELECT n.*, uses > 1 OR pos = 0 OR pos = max(pos) OVER (PARTITION BY user_id) AS cut FROM n JOIN u USING (node)),
k AS (SELECT user_id, pos, node, lead(pos) OVER w AS next_pos, lead(node) OVER w AS next_node, row_number() OVER w - 1 AS piece FROM c WHERE cut WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id AS way_id, CAST(piece AS BIGINT) AS piece, node AS a, next_node AS b, CAST(next_pos - pos + 1 AS BIGINT) AS n FROM k WHERE next_pos IS NOT NULL""")
def way_pieces(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", F.floor("value")).otherwise(F.col("event_id") + 1000000000).alias("node"))
    seen = F.array_sort(F.collect_list(F.struct("ts", "event_id", "node")))
    ways = rows.groupBy(F.col("user_id").alias("way_id")).agg(F.transform(seen, lambda p: p["node"]).alias("nodes"), F.transform(seen, lambda p: F.struct(p["event_id"].cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("line"))
    cut = links.way_pieces(ways.withColumn("tags", F.create_map(F.lit("highway"), F.lit("primary"))))
    return cut.select("way_id", F.col("piece").cast("long").alias("piece"), "a", "b", F.size("line").cast("long").alias("n"))


@query("""WITH ns AS (SELECT count(*) AS n FROM supplier),
w AS (SELECT c_custkey % ns.n AS eid, c_acctbal / 1000 - 2 AS dy, c_nationkey * 8.0 AS x0, c_nationkey * 8.0 + 120 AS x1, CASE WHEN c_acctbal > 9600 THEN -1 ELSE 1 END AS s FROM customer, ns),
p AS (SELECT s_suppkey AS eid, i, 5.0 + 10 * i AS x FROM supplier, (SELECT unnest(range(0, 20)) AS i)),
h AS (SELECT p.eid, p.i, w.s FROM p JOIN w ON p.eid = w.eid WHERE sqrt(pow(greatest(w.x0 - p.x, 0, p.x - w.x1), 2) + dy * dy) <= 12),
v AS (SELECT eid, i, CASE WHEN min(s) = max(s) THEN min(s) ELSE 0 END AS vote FROM h GROUP BY eid, i),
t AS (SELECT eid, count(*) AS n, count(*) FILTER (vote = 1) AS np, count(*) FILTER (vote = -1) AS nm, count(*) FILTER (vote = 0) AS nz FROM v GROUP BY eid)
SELECT eid, CASE WHEN np >= nm THEN 1 ELSE -1 END AS direction FROM t WHERE greatest(np, nm) >= nz AND n >= 0.6 * 20 AND greatest(np, nm) >= 0.8 * n""")
def direction_vote(spark, d):
    """Streets of 200 m, one per supplier and 100 m apart; a one-way way of 120 m beside one of them per customer."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    y = F.col("s_suppkey") * 100
    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("eid"), F.array(point(F.lit(0), y), point(F.lit(200), y)).alias("line"), F.lit(False).alias("bridged"))
    n = table(spark, d, "supplier", "s_suppkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").crossJoin(F.broadcast(n))  # n is one row
    y = (F.col("c_custkey") % F.col("n")) * 100 + (F.col("c_acctbal") / 1000 - 2)
    line = F.array(point(F.col("c_nationkey") * 8.0, y), point(F.col("c_nationkey") * 8.0 + 120, y))
    ways = c.select(F.col("c_custkey").alias("way_id"), F.when(F.col("c_acctbal") > 9600, F.reverse(line)).otherwise(line).alias("line"))
    return oneway.match_directions(edges, ways, MatchParams())


def _repair_round(i: int) -> str:
    """SQL: the strong parts of the network as round i finds it, and the flows that it opens."""
    return f"""a{i} AS (SELECT u, v FROM f UNION SELECT v, u FROM f WHERE (u, v) IN (SELECT (u, v) FROM open{i})),
r{i}(a, b) AS (SELECT v, v FROM vs UNION SELECT r{i}.a, a{i}.v FROM r{i} JOIN a{i} ON r{i}.b = a{i}.u),
s{i} AS (SELECT x.a AS v, min(x.b) AS scc FROM r{i} x JOIN r{i} y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
g{i} AS (SELECT comp, arg_max(scc, (n, -scc)) AS scc FROM (SELECT comp, scc, count(*) AS n FROM s{i} JOIN weak USING (v) GROUP BY comp, scc) GROUP BY comp),
bad{i} AS (SELECT v FROM s{i} WHERE scc NOT IN (SELECT scc FROM g{i})),
open{i + 1} AS (SELECT u, v FROM open{i} UNION SELECT u, v FROM f WHERE u IN (SELECT v FROM bad{i}) OR v IN (SELECT v FROM bad{i}))"""


@query(f"""WITH RECURSIVE {FLOWS}, vs AS (SELECT u AS v FROM f UNION SELECT v FROM f), ways AS (SELECT u AS a, v AS b FROM f UNION SELECT v, u FROM f), w(a, b) AS (SELECT v, v FROM vs UNION SELECT w.a, ways.b FROM w JOIN ways ON ways.a = w.b),
weak AS (SELECT a AS v, min(b) AS comp FROM w GROUP BY a), open0 AS (SELECT u, v FROM f WHERE false), {", ".join(map(_repair_round, range(4)))}
SELECT u * 100 + v AS eid FROM open4""")
def oneway_repair(spark, d):
    """The flows that must open for each part of the nations to stay strongly connected."""
    return C.repaired(flows(spark, d))


@query("SELECT p_name AS name, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS BIGINT) AS idx FROM part GROUP BY p_name")
def name_dictionary(spark, d):
    return sink.name_index(table(spark, d, "part").select(F.col("p_partkey").alias("eid"), F.col("p_name").alias("name")))


@query("SELECT o_custkey, CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS new FROM (SELECT DISTINCT o_custkey FROM orders)")
def renumber(spark, d):
    return roads.dense_ids(table(spark, d, "orders", "o_custkey").distinct(), "o_custkey", "new")


@query(f"""WITH RECURSIVE {CHAINS}, b AS (SELECT u AS a, v AS b, length FROM e UNION ALL SELECT v, u, length FROM e),
r(source, v, cost) AS (SELECT v, v, CAST(0 AS DOUBLE) FROM t UNION SELECT r.source, b.b, r.cost + b.length FROM r JOIN b ON r.v = b.a WHERE r.cost + b.length <= 1500)
SELECT source, v, min(cost) AS cost FROM r GROUP BY source, v""")
def bounded_shortest_path(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).cast("long").alias("v"))
    return routing.bounded_distances(chains(spark, d), turns, 1500.0)


@query("SELECT n_nationkey AS id, coalesce(r_name, n_name) AS name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey * 3")
def incremental_merge(spark, d):
    """Nations as published places, of which some are rebuilt under their region's name."""
    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    new = table(spark, d, "region").select((F.col("r_regionkey") * 3).alias("id"), F.col("r_name").alias("name"))
    return sink.merged_places(old, new, old.select("id", F.col("id").alias("ordinal")))


@query(f"""WITH {POINTS}, c AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM pts a JOIN pts b ON a.id < b.id),
s AS (SELECT a, b, distance, CASE WHEN distance <= 0.01 THEN 0 WHEN distance <= 0.03 THEN 1 ELSE 2 END AS stratum FROM c WHERE distance > 0 AND distance <= 0.06)
SELECT a, b, round(distance, 9) AS distance, CAST(stratum AS INTEGER) AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(a || '-' || b), a, b) AS n FROM s) WHERE n <= 20""")
def od_sampling(spark, d):
    return routing.od_pairs(points(spark, d).select("id", "x", "y"), (0.01, 0.03, 0.06), 20).select("a", "b", F.round("distance", 9).alias("distance"), F.col("stratum").cast("int").alias("stratum"))


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 2) AS v FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY v) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2.0 AS rank FROM s""")
def friedman_ranks(spark, d):
    scores = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("v"))
    return routing.mean_ranks(scores, "c_nationkey", "c_mktsegment", "v")


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))")
def pareto_front(spark, d):
    return routing.pareto_front(table(spark, d, "part", "p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice")


@query("WITH n AS (SELECT CAST(sqrt(count(*)) AS BIGINT) AS k FROM nation) SELECT (k + 1) * (k + 1) - 4 AS nodes, 2 * k * (k + 1) - 4 AS edges FROM n")
def street_graph(spark, d):
    """A graph from block faces, end to end. Streets run between and around the square of blocks; where they cross there
    are nodes, but for the four corners, which join two edges."""
    nodes, edges = build_graph(town(spark, d), CorridorParams(min_component_km=0.1, tile_m=200.0, tile_margin_m=60.0))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count_if(~F.col("bridged")).alias("edges")))  # a row each


@query(f"""WITH {POINTS}, p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y, label FROM pts), e AS (SELECT * FROM (SELECT lag(id) OVER (PARTITION BY label ORDER BY id) AS u, id AS v, x, y, label FROM p) WHERE u IS NOT NULL),
f AS (SELECT CAST(label AS VARCHAR) AS name, min(v) AS first FROM e GROUP BY label), i AS (SELECT name, row_number() OVER (ORDER BY first) - 1 AS idx FROM f)
SELECT CAST(count(*) AS BIGINT) AS edges, CAST((SELECT count(*) FROM p) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM i) AS BIGINT) AS names, CAST(sum(u) AS BIGINT) AS us, CAST(sum(v) AS BIGINT) AS vs, CAST(sum(round_even(abs(x) * 1000, 0)) AS BIGINT) AS dm, CAST(sum(idx) AS BIGINT) AS idx,
  CAST(sum(v) FILTER (label = 0) AS BIGINT) AS bridged, (SELECT string_agg(name, ',' ORDER BY idx) FROM i) AS listed, round((SELECT sum(round_even(x, 5)) FROM p), 5) AS lon, round(sum(round_even(y, 5)), 5) AS lat FROM e JOIN i ON i.name = CAST(e.label AS VARCHAR)""")
def payload_document(spark, d):
    """A graph document from points and chains between neighbours of a label."""
    p = roads.dense_ids(points(spark, d).select("id", "x", "y", "label"), "id", "n").select(F.col("n").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"), "label")
    before = F.lag("id").over(W.partitionBy("label").orderBy("id"))
    edges = p.withColumn("u", before).where("u is not null").select(F.col("id").alias("eid"), "u", F.col("id").alias("v"), (F.abs("lon") * 100).alias("length"), F.col("label").cast("string").alias("name"), F.array(F.struct("lon", "lat")).alias("line"), (F.col("label") == 0).alias("bridged"))
    doc = sink.graph_payload(materialise(p, "points"), materialise(edges, "points-edges"), "1", "Points", [1], "points", "EPSG:4326", {"half_width_m": 8.0})
    own = doc.select(F.from_json("payload", source.PAYLOAD).alias("p")).select("p.*")
    each = lambda c, k, n: F.aggregate(F.filter(c, lambda x, i: i % n == k), F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 5)
    return own.select(
        F.floor(F.size("edges") / 4).alias("edges"), F.floor(F.size("nodes") / 2).alias("nodes"), F.size("names").cast("long").alias("names"), *(each("edges", k, 4).alias(n) for k, n in enumerate(("us", "vs", "dm", "idx"))),
        F.aggregate("bridged", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bridged"), F.array_join("names", ",").alias("listed"), sums(F.filter("nodes", lambda x, i: i % 2 == 0)).alias("lon"), sums(F.transform("lines", lambda x: x[1])).alias("lat"),
    )


from . import streets  # noqa: E402,F401  adds its queries to the same lists
