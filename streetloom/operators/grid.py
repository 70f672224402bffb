"""Spatial joins as equi-joins on grid cells with an exact predicate behind them.

One side is copied to the neighbouring cells, the other is not, so every pair of points meets in exactly one cell.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import crosses, distance, point_segment_distance, segments
from ..tables import free, materialise, replace, unbroadcast


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def in_cells(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumn("cx", cell(F.col(x), size)).withColumn("cy", cell(F.col(y), size))


def in_near_cells(points: DataFrame, size: float, x: str = "x", y: str = "y", reach: int = 1) -> DataFrame:
    """Each row once for each of the (2 reach + 1)^2 cells around its own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    rows = points.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return rows.withColumn("cx", cell(F.col(x), size) + F.col("_dx")).withColumn("cy", cell(F.col(y), size) + F.col("_dy")).drop("_dx", "_dy")


def range_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (columns x, y and others, which must differ in name) at most `radius` apart, with their distance.

    right's x and y come back as rx and ry."""
    l, r = in_cells(left, radius), in_near_cells(right, radius).withColumnsRenamed({"x": "rx", "y": "ry"})
    pairs = l.join(unbroadcast(r), ["cx", "cy"]).drop("cx", "cy")
    return pairs.withColumn("distance", distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))).where(F.col("distance") <= radius)


def pairs_within(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Pairs a < b of points at most `radius` apart: a, b, distance."""
    a = points.select(F.col(key).alias("a"), "x", "y")
    b = points.select(F.col(key).alias("b"), "x", "y")
    return range_join(a, b, radius).where("a < b").select("a", "b", "distance")


def knn_within(left: DataFrame, right: DataFrame, radius: float, k: int, left_key: str, right_key: str) -> DataFrame:
    """The k nearest right points within `radius` of each left point, ties by right_key: adds distance and rank (from 1)."""
    near = range_join(left, right, radius)
    return near.withColumn("rank", F.row_number().over(W.partitionBy(left_key).orderBy("distance", right_key))).where(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, start: float, left_key: str, right_key: str) -> DataFrame:
    """The nearest right point of each left point, however far: all left columns, right_key and distance.

    Cells of size `start` are searched first; rows without a hit go to a round with cells four times as large. A hit counts
    once its distance is within the cell size, as the searched block then holds any closer point. Once the cells are as
    large as the box around all points the round finds everything, so the rounds end. Ties go to the smaller key. Rows
    with a null key or a null or non-finite coordinate match nothing, nor does any row where there is no target."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = lambda df, key: df.where(F.col(key).isNotNull() & fine("x") & fine("y"))
    none = (F.lit(None).cast(right.schema[right_key].dataType).alias(right_key), F.lit(None).cast("double").alias("distance"))
    targets = materialise(usable(right.select(right_key, "x", "y"), right_key), "nearest-targets")
    if targets.isEmpty():
        return left.select("*", *none)
    todo = materialise(usable(left.select(left_key, "x", "y"), left_key).distinct(), "nearest-todo")
    ends = [f(c) for c in "xy" for f in (F.min, F.max)]
    x0, x1, y0, y1 = targets.select("x", "y").union(todo.select("x", "y")).agg(*ends).first()
    most, size, found = 2 * max(x1 - x0, y1 - y0, start), start, None
    while not todo.isEmpty():
        hits = range_join(todo, targets, size)
        best = hits.groupBy(left_key, "x", "y").agg(F.min(F.struct("distance", right_key)).alias("best")).select(left_key, "x", "y", F.col(f"best.{right_key}").alias(right_key), F.col("best.distance").alias("distance"))
        best = materialise(best, "nearest-hits")
        found = best if found is None else found.union(best)
        if size > most:
            break
        todo = replace(todo, todo.join(best, [left_key, "x", "y"], "left_anti"), "nearest-todo")
        size = min(4 * size, 1.01 * most) if size < most else 1.01 * size
    if found is None:
        return left.select("*", *none)
    return left.join(found, [left_key, "x", "y"], "left").select(*left.columns, right_key, "distance")


#: Distances from segments tie if they are equal once rounded to this part of a unit, as a foot point is rounded itself.
_EQUAL = 1e-9
#: So many points at most are broadcast to the cells of segments.
_FEW = 10_000


def nearest_segment(left: DataFrame, segments_: DataFrame, start: float, left_key: str, right_key: str) -> DataFrame:
    """The nearest segment (right_key, ax, ay, bx, by) of each point (left_key, x, y), however far: left_key, right_key, distance.

    A point is compared with the segments that pass its own cell, which bounds its distance, and then with those in all
    cells that a circle of this radius touches, so it is settled with the first segment in its cell. Points in empty cells
    go to a round with cells four times as large, until one cell holds everything. Distances that agree to nine places tie,
    and ties go to the smaller key: of lines through one point none is nearer because its foot point was rounded otherwise."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    targets = materialise(segments_.where(functools.reduce(lambda a, b: a & b, map(fine, ("ax", "ay", "bx", "by")))).select(right_key, "ax", "ay", "bx", "by"), "segment-targets")
    todo = materialise(left.where(fine("x") & fine("y")).select(left_key, "x", "y"), "segment-todo")
    none = left.select(left_key, F.lit(None).cast(segments_.schema[right_key].dataType).alias(right_key), F.lit(None).cast("double").alias("distance"))
    if targets.isEmpty() or todo.isEmpty():
        return none
    corners = targets.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(targets.select("bx", "by")).union(todo.select("x", "y"))
    x0, x1, y0, y1 = corners.agg(*(f(c) for c in "xy" for f in (F.min, F.max))).first()
    most, size, found = 2 * max(x1 - x0, y1 - y0, start), start, None
    slack = 1e-12 * max(map(abs, (x0, x1, y0, y1)))
    gap = point_segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    while n := todo.count():
        cells = passed_cells(targets, size, x0, y0, max(size / 1000, slack))
        # A bounded number of points may go to all tasks, the cells of segments never.
        meet = lambda at: F.broadcast(at).join(cells, ["cx", "cy"]) if n <= _FEW else at.join(unbroadcast(cells), ["cx", "cy"])
        own = todo.withColumn("cx", cell(F.col("x") - x0, size)).withColumn("cy", cell(F.col("y") - y0, size))
        bounds = materialise(todo.join(meet(own).groupBy(left_key).agg(F.min(gap).alias("bound")), left_key), "segment-bounds")
        # What ties with the nearest may lie a rounding further.
        reach = F.col("bound") + _EQUAL
        around = lambda c, c0: F.explode(F.sequence(cell(F.col(c) - reach - c0, size), cell(F.col(c) + reach - c0, size)))
        near = meet(bounds.withColumn("cx", around("x", x0)).withColumn("cy", around("y", y0))).withColumn("distance", gap).where(F.col("distance") <= reach)
        best = near.groupBy(left_key).agg(F.min(F.struct(F.round(F.col("distance") * 1e9).alias("steps"), right_key, "distance")).alias("best"))
        best = materialise(best.select(left_key, F.col(f"best.{right_key}").alias(right_key), F.col("best.distance").alias("distance")), "segment-hits")
        found = best if found is None else found.union(best)
        if size > most:
            break
        todo = replace(todo, todo.join(best, left_key, "left_anti"), "segment-todo")
        free(bounds)
        size = 4 * size
    return left.select(left_key).join(found, left_key, "left")


def passed_cells(segments: DataFrame, size: float, x0: float, y0: float, slack: float) -> DataFrame:
    """Each segment (ax, ay, bx, by) once for each cell, counted from (x0, y0), that holds a point within slack of it in x
    and in y; a long one costs in proportion to its length. slack has to be well above the rounding of coordinates."""
    c = F.col
    at = lambda v, v0: cell(v - v0, size)
    rows = segments.withColumn("cx", F.explode(F.sequence(at(F.least("ax", "bx") - slack, x0), at(F.greatest("ax", "bx") + slack, x0))))
    # Where along it, from 0 to 1, the segment is at the column's sides, which give it slack.
    along = lambda x, flat: F.when(c("ax") == c("bx"), flat).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - c("ax")) / F.nullif(c("bx") - c("ax"), F.lit(0.0)))))
    side = c("cx") * size + x0
    ends = [c("ay") + along(x, flat) * (c("by") - c("ay")) for x, flat in ((side - slack, 0.0), (side + size + slack, 1.0))]
    rows = rows.withColumn("_lo", at(F.least(*ends) - slack, y0)).withColumn("_hi", at(F.greatest(*ends) + slack, y0))
    return rows.withColumn("cy", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def segment_cells(segments: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Each segment (ax, ay, bx, by) once for each cell that its box, widened by margin, touches."""
    lo = lambda a, b: cell(F.least(a, b) - margin, size)
    hi = lambda a, b: cell(F.greatest(a, b) + margin, size)
    rows = segments.withColumn("cx", F.explode(F.sequence(lo(F.col("ax"), F.col("bx")), hi(F.col("ax"), F.col("bx")))))
    return rows.withColumn("cy", F.explode(F.sequence(lo(F.col("ay"), F.col("by")), hi(F.col("ay"), F.col("by")))))


def without_meeting(links: DataFrame, barriers: DataFrame, predicate, size: float, key: str) -> DataFrame:
    """Anti-join: links (key, ax, ay, bx, by, ...) that meet no barrier segment by predicate('l', 'b')."""
    l = segment_cells(links.select(key, "ax", "ay", "bx", "by"), size).alias("l")
    b = segment_cells(barriers.select("ax", "ay", "bx", "by"), size).alias("b")
    bad = l.join(unbroadcast(b), (F.col("l.cx") == F.col("b.cx")) & (F.col("l.cy") == F.col("b.cy")) & predicate("l", "b")).select(F.col(f"l.{key}").alias(key)).distinct()
    return links.join(bad, key, "left_anti")


def without_crossing(links: DataFrame, lines: DataFrame, line_key: str, size: float, key: str) -> DataFrame:
    """Anti-join: links (key, ax, ay, bx, by, ...) that cross no polyline (line_key, line), at a vertex or between.

    A link crosses a line if points inside both are common to them, but no stretch. Inside a line is all of it but its two
    ends, so its other vertices count; inside a link are all points but its ends, so links may begin and end on lines."""
    segs = segments(lines, line_key)
    last = segs.groupBy(line_key).agg(F.max("seg").alias("last"))
    b = segment_cells(segs.join(last, line_key).select(F.col(line_key).alias("line_key"), "ax", "ay", "bx", "by", (F.col("seg") < F.col("last")).alias("goes_on")), size).alias("b")
    l = segment_cells(links.select(key, "ax", "ay", "bx", "by"), size).alias("l")
    c = F.col
    dx, dy = c("l.bx") - c("l.ax"), c("l.by") - c("l.ay")
    square = dx * dx + dy * dy

    def place(x: str, y: str) -> tuple[Column, Column]:
        """Whether a point is on the link's straight line, and where along it, from 0 to square."""
        px, py = c(x) - c("l.ax"), c(y) - c("l.ay")
        return dx * py - dy * px == 0, px * dx + py * dy

    (a_on, a_at), (b_on, b_at) = place("b.ax", "b.ay"), place("b.bx", "b.by")
    at_vertex = c("b.goes_on") & b_on & (b_at > 0) & (b_at < square)
    along = a_on & b_on & (F.least(F.greatest(a_at, b_at), square) > F.greatest(F.least(a_at, b_at), F.lit(0.0)))
    met = l.join(unbroadcast(b), (c("l.cx") == c("b.cx")) & (c("l.cy") == c("b.cy")) & (crosses("l", "b") | at_vertex | along))
    met = met.select(c(f"l.{key}").alias(key), "line_key", along.alias("along"), (crosses("l", "b") | at_vertex).alias("meets"))
    bad = met.groupBy(key, "line_key").agg(F.max("along").alias("along"), F.max("meets").alias("meets")).where("meets and not along").select(key).distinct()
    return links.join(bad, key, "left_anti")
