"""Graph operators on small graphs with hand-made expectations and against plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.config import CorridorParams
from streetloom.kernels import finders, paths, raster
from streetloom.operators import components as C
from streetloom.functions import lines as L
from streetloom.operators import corridor, grid, links, roads
from streetloom.operators.detours import far_pairs, link_detours
from streetloom.plans.build import build_graph
from streetloom.tables import materialise

LINE = "array<struct<x:double,y:double>>"


def edges_of(spark, rows, xy):
    data = [(i, u, v, float(d), [xy[u], xy[v]], b) for i, (u, v, d, *rest) in enumerate(rows) for b in [bool(rest and rest[0])]]
    return spark.createDataFrame(data, f"eid long, u long, v long, length double, line {LINE}, bridged boolean")


def nodes_of(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in xy.items()], "id long, x double, y double")


def line_xy(n, step=100.0):
    return {i: (i * step, 0.0) for i in range(n)}


def pixels(spark, mask):
    width = mask.shape[1]
    return spark.createDataFrame([(int(k),) for k in raster.skeleton_keys(mask, 0, 0, width)], "key long"), width


def cross():
    m = np.zeros((21, 21), bool)
    m[10], m[:, 10] = True, True
    return m


def h_shape():
    m = np.zeros((30, 40), bool)
    m[5, 2:38], m[5:25, 20], m[24, 10:30] = True, True, True
    return m


def test_cross_of_pixels(spark):
    keys, width = pixels(spark, cross())
    nodes, edges = corridor.pixel_graph(keys, width)
    assert nodes.count() == 5 and edges.count() == 4
    assert sorted(r.degree for r in roads.degrees(edges).collect()) == [1, 1, 1, 1, 4]


def test_h_shape_has_five_edges(spark):
    keys, width = pixels(spark, h_shape())
    nodes, edges = corridor.pixel_graph(keys, width)
    assert edges.count() == 5
    assert edges.agg(F.sum(F.size("path") - 1)).first()[0] > 60  # 73 steps, less those inside the junctions


def test_ring_keeps_a_node(spark):
    y, x = np.mgrid[0:41, 0:41]
    r = np.hypot(x - 20, y - 20)
    mask = raster.thin((r > 12) & (r < 16))
    nodes, edges = corridor.pixel_graph(*pixels(spark, mask))
    assert nodes.count() >= 1 and edges.count() >= 1
    assert all(d.degree % 2 == 0 for d in roads.degrees(edges).collect())
    assert edges.agg(F.sum(F.size("path") - 1)).first()[0] >= 70


def test_spur_rounds(spark):
    xy = line_xy(3)
    kept = roads.prune_spurs(edges_of(spark, [(0, 1, 50), (1, 2, 10)], xy), 20.0).collect()
    assert [(r.u, r.v) for r in kept] == [(0, 1)]
    assert roads.prune_spurs(edges_of(spark, [(0, 1, 5)], xy), 20.0).count() == 0


def test_degree_two_nodes_merge(spark):
    xy = line_xy(3)
    (r,) = roads.contract_chains(edges_of(spark, [(0, 1, 50), (1, 2, 10)], xy)).collect()
    assert ({r.u, r.v}, r.length, len(r.line)) == ({0, 2}, 60.0, 3)
    assert roads.contract_chains(edges_of(spark, [(0, 1, 50), (1, 2, 10, True)], xy)).count() == 2


def test_ring_keeps_two_nodes(spark):
    xy = {0: (0.0, 0.0), 1: (1.0, 0.0), 2: (1.0, 1.0), 3: (0.0, 1.0)}
    got = roads.contract_chains(edges_of(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1)], xy)).collect()
    assert len(got) == 2 and sum(r.length for r in got) == 4
    assert {frozenset((r.u, r.v)) for r in got} == {frozenset((got[0].u, got[0].v))}


def test_junctions_merge_at_their_mean(spark):
    xy = {0: (0.0, 0.0), 1: (4.0, 0.0), 2: (-50.0, 9.0), 3: (-50.0, -9.0), 4: (50.0, 9.0), 5: (50.0, -9.0)}
    edges = edges_of(spark, [(0, 1, 4), (0, 2, 50), (0, 3, 50), (1, 4, 50), (1, 5, 50)], xy)
    nodes, kept = roads.merge_junctions(nodes_of(spark, xy), edges, 12.0)
    assert kept.count() == 4
    assert [(r.x, r.y) for r in nodes.where("id = 0").collect()] == [(2.0, 0.0)]
    assert roads.degrees(kept).where("id = 0").first().degree == 4


def test_parts_are_linked_at_their_gap(spark):
    xy = {i: (x, 0.0) for i, x in enumerate((0.0, 100.0, 160.0, 260.0, 2000.0, 2100.0))}
    edges = edges_of(spark, [(0, 1, 100), (2, 3, 100), (4, 5, 100)], xy)
    (r,) = roads.link_components(nodes_of(spark, xy), edges, 100.0).collect()
    assert ({r.u, r.v}, r.length) == ({1, 2}, 60.0)


@pytest.mark.parametrize("km, kept", [(20.0, {0, 1, 2, 3}), (100.0, {0, 1})])
def test_major_parts(spark, km, kept):
    edges = edges_of(spark, [(0, 1, 30_000), (2, 3, 25_000), (4, 5, 500)], line_xy(6))
    assert {r.id for r in roads.major_parts(edges, km).collect()} == kept


def test_carriageways_are_linked_around_a_block(spark):
    xy = {i: (x, y) for i, (x, y) in enumerate((x, y) for y in (0.0, 40.0) for x in (0.0, 500.0, 1000.0))}
    edges = edges_of(spark, [(0, 1, 500), (1, 2, 500), (3, 4, 500), (4, 5, 500), (2, 5, 3000)], {**xy})
    edges = edges.where("eid < 4").union(edges.where("eid = 4").withColumn("line", F.expr("array(named_struct('x', 1000D, 'y', 0D), named_struct('x', 2500D, 'y', 20D), named_struct('x', 1000D, 'y', 40D))")))
    barriers = spark.createDataFrame([(400.0, 20.0, 600.0, 20.0)], "ax double, ay double, bx double, by double")
    for many in (10_000, 0):  # with and without the searches ahead
        got = {frozenset((r.u, r.v)) for r in link_detours(nodes_of(spark, xy), edges, barriers, 70.0, 10.0, many).collect()}
        assert got == {frozenset((0, 3)), frozenset((2, 5))}


@pytest.mark.parametrize("line, kept", [
    ([(0, -4), (0, -2), (0, 0), (0, 2), (0, 4)], False), ([(0, -4), (0, -1), (0, 3)], False), ([(0, -4), (0, 0)], True), ([(-5, 5), (0, 0), (5, 5)], False),
    ([(-10, 0), (-10, 5)], True), ([(-20, 0), (20, 0)], True), ([(-5, 5), (-5, 0), (5, 0), (5, 5)], True), ([(-10, -5), (-10, 5)], True), ([(0, 1), (0, 5)], True),
])
def test_links_cross_lines_at_vertices_too(spark, line, kept):
    link = spark.createDataFrame([(1, -10.0, 0.0, 10.0, 0.0)], "k int, ax double, ay double, bx double, by double")
    lines = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in line])], f"eid long, line {LINE}")
    assert grid.without_crossing(link, lines, "eid", 7.0, "k").count() == int(kept)


def test_nearest_ends_with_nulls_and_far_points(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0), (3, None, 0.0), (4, nan, 0.0), (5, 0.0, inf), (None, 0.0, 0.0)], "a long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (6, -3.0, 4.0), (8, nan, 0.0), (9, None, None)], "b long, x double, y double")
    got = {r.a: (r.b, r.distance) for r in grid.nearest(left, right, 0.5, "a", "b").collect()}
    assert got[1] == (6, 5.0) and got[2][0] == 7 and all(got[k] == (None, None) for k in (3, 4, 5, None)) and len(got) == 6
    assert {r.b for r in grid.nearest(left, right.where("b > 7"), 0.5, "a", "b").collect()} == {None}
    walls = spark.createDataFrame([(1, -50.0, 3.0, 50.0, 3.0), (2, 0.0, 4.0, 0.0, 9.0)], "f long, ax double, ay double, bx double, by double")
    near = {r.a: (r.f, r.distance) for r in grid.nearest_segment(left.where("a is not null"), walls, 0.5, "a", "f").collect()}
    assert near[1] == (1, 3.0) and near[2][0] == 1 and near[3] == (None, None)


def test_nearest_segments_tie_up_to_rounding(spark):
    """The foot point on the first line is rounded, that on the second is its end; and a tie just beyond the first cells."""
    at = spark.createDataFrame([(1, 1.4, 0.7), (2, 100.0, 0.0)], "a long, x double, y double")
    walls = [(1, 0.0, 0.0, 3.0, 1.5), (2, 1.4, 0.7, 5.0, 5.0), (3, 99.0, 0.5 + 4e-10, 101.0, 0.5 + 4e-10), (4, 99.0, 0.5, 101.0, 0.5)]
    walls = spark.createDataFrame(walls, "f long, ax double, ay double, bx double, by double")
    gap = L.point_segment_distance(F.lit(1.4), F.lit(0.7), *(F.col(c) for c in ("ax", "ay", "bx", "by")))
    assert [r.gap for r in walls.where("f = 1").select(gap.alias("gap")).collect()][0] > 0
    assert {r.a: r.f for r in grid.nearest_segment(at, walls, 0.5, "a", "f").collect()} == {1: 1, 2: 3}


@pytest.mark.parametrize("few", [10_000, 0])
def test_nearest_segments_equal_a_comparison_with_all(spark, monkeypatch, few):
    """Points and segments of many sizes, upright, level and without length among them, away from and across zero."""
    monkeypatch.setattr(grid, "_FEW", few)
    rng = random.Random(5)
    spot = lambda: (rng.choice([rng.uniform(-40, 60), float(rng.randrange(-40, 60)), rng.uniform(0, 2)]), rng.uniform(-900, -880))
    at = [(i, *spot()) for i in range(300)] + [(300, 4000.0, 3000.0), (301, -40.0, -2000.0)]
    walls = [(1, 0.0, -890.0, 0.0, -886.0), (2, 4.0, -888.0, 4.0, -888.0), (3, -8.0, -896.0, 8.0, -896.0), (4, 1.0, -899.0, 1.0 + 1e-13, -881.0)]
    for i in range(5, 60):
        (x, y), long = spot(), rng.choice([0.01, 1.0, 30.0])
        walls.append((i, x, y, x + rng.uniform(-long, long), y + rng.uniform(-long, long)))
    points, segments = spark.createDataFrame(at, "a long, x double, y double"), spark.createDataFrame(walls, "f long, ax double, ay double, bx double, by double")
    gap = L.point_segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    every = points.crossJoin(segments).select("a", F.struct(F.round(gap * 1e9).alias("steps"), "f").alias("best")).groupBy("a").agg(F.min("best").alias("best"))
    assert {r.a: r.f for r in grid.nearest_segment(points, segments, 2.0, "a", "f").collect()} == {r.a: r.best.f for r in every.collect()}


def test_a_long_segment_is_in_the_cells_that_it_passes(spark):
    """One across 1,000 x 1,000 cells passes 1,999 of them and comes near a few more, but not near the million of its box."""
    long = spark.createDataFrame([(1, 0.5, 0.25, 1000.4, 1000.1)], "f long, ax double, ay double, bx double, by double")
    got = {(r.cx, r.cy) for r in grid.passed_cells(long, 1.0, 0.0, 0.0, 1e-3).collect()}
    inside = {(int(x), int(y)) for i in range(100_001) for x, y in [(0.5 + 999.9 * i / 100_000, 0.25 + 999.85 * i / 100_000)]}
    assert inside <= got and len(got) < 2100


def test_long_lines_and_chains_cost_in_proportion(spark):
    """A line of 20,000 points and a chain of 3,000 edges: quadratic plans took minutes for them."""
    began = time.perf_counter()
    xs = [float(i) for i in range(20_001)]
    line = spark.createDataFrame([(1, [(x, 0.0) for x in xs])], f"k int, line {LINE}")
    got = L.segments(line, "k").agg(F.max("before"), F.count("*")).first()
    assert tuple(got) == (19_999.0, 20_000)
    s = L.samples(line, "k", 10.0).agg(F.count("*"), F.min("hx"), F.max("x"), F.min("x")).first()
    assert tuple(s) == (2000, 1.0, 19_995.0, 5.0)
    assert tuple(L.middles(line, "k").first())[1:] == (10_000.0, 0.0)
    xy = line_xy(3001)
    (r,) = roads.contract_chains(edges_of(spark, [(i, i + 1, 1) for i in range(3000)], xy)).collect()
    assert ({r.u, r.v}, r.length, [p.x for p in r.line] in ([100.0 * i for i in range(3001)], [100.0 * i for i in range(3000, -1, -1)])) == ({0, 3000}, 3000.0, True)
    assert time.perf_counter() - began < 120


def test_far_pairs_by_bounded_search(spark):
    edges = edges_of(spark, [(0, 1, 100), (1, 2, 100), (2, 3, 900)], line_xy(4))
    pairs = spark.createDataFrame([(0, 2, 30.0), (0, 3, 30.0), (2, 3, 1.0), (3, 9, 5.0)], "u long, v long, gap double")
    assert {(r.u, r.v) for r in far_pairs(pairs, edges, 10.0).collect()} == {(0, 3), (2, 3), (3, 9)}


def test_components_and_strong_components_match_plain_search(spark):
    r = random.Random(3)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(38)})
    ahead = {v: {b for a, b in pairs if a == v} for v in range(30)}

    def reach(v, step):
        seen, todo = {v}, [v]
        while todo:
            for w in step(todo.pop()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    table = spark.createDataFrame(pairs, "u long, v long")
    vertices = spark.range(30).withColumnRenamed("id", "v")
    weak = {x.v: x.comp for x in C.components(table, vertices).collect()}
    assert weak == {v: min(reach(v, lambda x: ahead[x] | {a for a, b in pairs if b == x})) for v in range(30)}
    strong = {x.v: x.scc for x in C.strong_components(table, vertices).collect()}
    full = {v: reach(v, lambda x: ahead[x]) for v in range(30)}
    assert strong == {v: min(w for w in full[v] if v in full[w]) for v in range(30)}


def test_added_dead_ends_peel_in_cascade(spark):
    assert roads.peel_new(edges_of(spark, [(0, 1, 1), (1, 2, 1)], line_xy(3)), 1).count() == 0


def test_finders_agree_on_random_grids():
    r = random.Random(1)
    nodes = [(i * 8 + j, 100.0 * i, 100.0 * j) for i in range(8) for j in range(8)]
    links = [(a, b, 100.0 * r.uniform(1, 1.5)) for i in range(8) for j in range(8) for a, b in (((i * 8 + j), i * 8 + j + 1), (i * 8 + j, i * 8 + j + 8)) if b < 64 and (b == a + 8 or j < 7)]
    g = finders.Graph.of(nodes, links)
    for s, t in ((0, 63), (5, 40), (7, 7)):
        path, cost, _ = finders.dijkstra(g, s, t)
        for name in ("astar", "alt", "bidirectional", "contraction"):
            p, c, _ = finders.FINDERS[name](g, s, t)
            assert c == pytest.approx(cost) and p[0] == s and p[-1] == t
            assert c == pytest.approx(finders.cost_of(g, p))
        for name in ("greedy", "beam", "ant_colony", "genetic", "annealing", "particle_swarm", "nsga2"):
            p, c, _ = finders.FINDERS[name](g, s, t, 1)
            assert c >= cost - 1e-6 and p[0] == s and p[-1] == t and c == pytest.approx(finders.cost_of(g, p))
    # As wide as the grid, a beam looks at all nodes of a level; the shortest paths here have the fewest edges.
    assert finders.beam(g, 0, 63)[1] == pytest.approx(finders.dijkstra(g, 0, 63)[1])
    front = [v for _, v in finders.pareto_paths(g, 0, 63, 1)]
    assert finders.fronts(front) == [list(range(len(front)))]


def test_a_beam_takes_the_shortest_parent():
    g = finders.Graph.of([(i, 0.0, 0.0) for i in range(4)], [(0, 1, 1.0), (0, 2, 5.0), (1, 3, 9.0), (2, 3, 1.0)])
    assert finders.beam(g, 0, 3)[:2] == ([0, 2, 3], 6.0)


def test_raster_kernels():
    m = np.ones((40, 40), bool)
    m[5:8, 5:8] = False
    m[20:40, 20:40] = False
    filled = raster.fill_holes(m, 9)
    assert filled[5:8, 5:8].all() and not filled[20:, 20:].any()
    thin = raster.thin(np.ones((5, 30), bool))
    assert 20 <= thin.sum() <= 30
    gap = np.ones((9, 9), bool)
    gap[4, 4] = False
    assert raster.close(gap, 1)[4, 4]


def test_simplify_keeps_far_points():
    assert paths.simplify([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], 1.0) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert paths.simplify([], 1.0) == []


def test_tiles_give_the_whole_image(spark):
    from streetloom.plans.catalogue import town

    faces = town(spark, "/root/testdata/sf0.001")
    whole, _ = corridor.skeleton(faces, CorridorParams(tile_m=1e6))
    tiled, _ = corridor.skeleton(faces, CorridorParams(tile_m=150.0, tile_margin_m=60.0))
    a, b = ({r.key for r in x.collect()} for x in (whole, tiled))
    assert len(a) > 1000 and a == b


def test_crossroad_end_to_end(spark):
    x, y = 500_000.0, 7_400_000.0
    faces = []
    for dx, dy in ((6, 0), (0, 6)):
        for s in (1, -1):
            for t in (1, -1):
                a = (x + s * dx + t * (6 if dy else 0) * 1.0, y + s * dy + t * (6 if dx else 0) * 1.0)
                far = (a[0] if dx else x + t * 200.0, y + t * 200.0 if dx else a[1])
                faces.append((len(faces), "Rua A", [a, far]))
    table = spark.createDataFrame(faces, f"face_id long, name string, line {LINE}")
    nodes, edges = build_graph(table, CorridorParams(min_spur_m=10.0))
    rows = edges.collect()
    assert C.components(edges).select("comp").distinct().count() == 1
    assert max(r.degree for r in roads.degrees(edges).collect()) == 4
    assert 650 < sum(r.length for r in rows) < 820
    assert {r.name for r in rows} == {"Rua A"}
    assert nodes.count() == len({v for r in rows for v in (r.u, r.v)})


def test_exploded_rows_are_not_broadcast(spark):
    """Points every few metres of lines in a small file: Spark takes their size from the file's."""
    k = F.col("id")
    line = F.array(*(F.struct((k * 0.0 + x).alias("x"), (k * 1e4).alias("y")) for x in (0.0, 1000.0)))
    lines = materialise(spark.range(1000).select(k.alias("pid"), k.alias("eid"), line.alias("line")), "test-lines")
    points = L.densified(lines, "eid", 5.0).select("eid", "x", "y")
    walls = L.segments(lines, "eid").select("ax", "ay", "bx", "by")
    links_ = walls.withColumn("k", F.monotonically_increasing_id())
    plans = [links.coverage(lines, lines), grid.pairs_within(points, 1.0, "eid")]
    plans += [grid.without_meeting(links_, walls, L.intersects, 4.0, "k")]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "[cx" not in "".join(x for x in plan.splitlines() if "BroadcastHashJoin" in x), plan
    assert [tuple(r) for r in links.coverage(lines, lines).agg(F.count("*"), F.min("share")).collect()] == [(1000, 1.0)]
