"""Polylines as array<struct<x, y>> columns: length, segments, samples, headings, orientation, rounding, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XY = "struct<x:double,y:double>"


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _gap(p: Column, q: Column) -> Column:
    return distance(p["x"], p["y"], q["x"], q["y"])


def segment_lengths(line: Column) -> Column:
    """array<double>, one shorter than the line; empty for lines of fewer than two points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), _gap)


def length(line: Column) -> Column:
    return F.aggregate(segment_lengths(line), F.lit(0.0), lambda a, x: a + x)


def reversed_line(line: Column) -> Column:
    return F.reverse(line)


def oriented(line: Column, x: Column, y: Column) -> Column:
    """The line, turned round if its last point is closer to (x, y) than its first; ties keep it."""
    first, last = line[0], F.element_at(line, -1)
    return F.when(distance(first["x"], first["y"], x, y) <= distance(last["x"], last["y"], x, y), line).otherwise(F.reverse(line))


def round_half_even(x: Column, digits: int = 5) -> Column:
    return F.bround(x, digits)


def quantised(metres: Column) -> Column:
    """Whole decimetres, halves to even."""
    return F.bround(metres * 10, 0).cast("long")


def flat(line: Column, digits: int = 5, first: str = "lon", second: str = "lat") -> Column:
    """[lon, lat, lon, lat, ...], rounded."""
    return F.flatten(F.transform(line, lambda p: F.array(F.bround(p[first], digits), F.bround(p[second], digits))))


def unflat(vector: Column, names: tuple[str, ...]) -> Column:
    """A flat vector as structs of len(names) fields; a rest that fills no struct is left out."""
    k = len(names)
    n = F.floor(F.size(vector) / k).cast("int")
    row = lambda i: F.struct(*(vector[i * k + j].alias(name) for j, name in enumerate(names)))
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(i < n, row(i))), lambda r: r.isNotNull())


def box(line: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


_BLOCK = 256


def running_sums(values: Column) -> Column:
    """array<double>, one longer than the array: 0, the first number, the sum of the first two, and so on.

    By blocks, so that the arrays that grow inside stay short and a long line costs in proportion to its points."""
    empty = F.array().cast("array<double>")
    start = lambda s: F.struct(s.alias("s"), empty.alias("out"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    scan = lambda part, s: F.aggregate(part, start(s), step)
    # A zero at the end makes the last sum one of those that are ahead of a number.
    padded = F.concat(values, F.array(F.lit(0.0)))
    numbers = F.sequence(F.lit(0), F.floor((F.size(padded) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(F.array(padded), lambda v: F.transform(numbers, lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))[0]
    zero = F.lit(0.0)

    def joined(parts):
        # Each block begins with the sum that the one before it came to, as one scan over all would have it.
        begin = F.struct(zero.alias("s"), F.array().cast("array<array<double>>").alias("out"))

        def carry(acc, part):
            got = scan(part, acc["s"])
            return F.transform(F.array(got), lambda g: F.struct(g["s"].alias("s"), F.concat(acc["out"], F.array(g["out"])).alias("out")))[0]

        return F.flatten(F.aggregate(parts, begin, carry, lambda acc: acc["out"]))

    return F.transform(F.array(blocks), joined)[0]


def segments(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """One row per segment: key, seg, ax, ay, bx, by, before (length ahead of it), len."""
    rows = lines.where(F.size(line) >= 2).select(key, F.col(line).alias("_line")).withColumn("_len", segment_lengths(F.col("_line"))).withColumn("_sums", running_sums(F.col("_len")))
    # Each row of the explosion holds its own two points and numbers only.
    n = F.size("_len")
    part = F.arrays_zip(F.slice("_line", F.lit(1), n).alias("a"), F.slice("_line", F.lit(2), n).alias("b"), F.slice("_sums", F.lit(1), n).alias("before"), F.col("_len").alias("len"))
    rows = rows.select(key, F.posexplode(part).alias("seg", "s"))
    return rows.select(key, F.col("seg").cast("long").alias("seg"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"), F.col("s.before").alias("before"), F.col("s.len").alias("len"))


def densified(lines: DataFrame, key: str, step: float, line: str = "line") -> DataFrame:
    """The first point of each line and then equal steps of at most `step` along each segment: key, seg, k, x, y."""
    s = segments(lines, key, line)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("len") / step)).cast("int")
    inner = s.select(key, "seg", "ax", "ay", "bx", "by", pieces.alias("pieces"), F.explode(F.sequence(F.lit(1), pieces)).alias("k"))
    t = F.col("k") / F.col("pieces")
    inner = inner.select(key, "seg", "k", (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("y"))
    first = lines.where(F.size(line) >= 1).select(key, F.lit(-1).cast("long").alias("seg"), F.lit(0).alias("k"), F.col(line)[0]["x"].alias("x"), F.col(line)[0]["y"].alias("y"))
    return first.unionByName(inner)


def middles(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, x, y): the point half way along each line; the only point of a line without length."""
    long = lines.where(F.size(line) >= 1).select(key, F.col(line).alias("_line")).withColumn("_sums", running_sums(segment_lengths(F.col("_line"))))
    half = F.element_at("_sums", -1) / 2
    # The first segment that reaches the place: as many sums lie below it.
    i = F.greatest(F.size(F.filter("_sums", lambda x: x < half)) - 1, F.lit(0))
    a, b = F.get("_line", i), F.coalesce(F.get("_line", i + 1), F.get("_line", i))
    t = F.coalesce((half - F.get("_sums", i)) / F.nullif(F.get("_sums", i + 1) - F.get("_sums", i), F.lit(0.0)), F.lit(0.0))
    return long.select(key, (a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))


def at_length(line: Column, d: Column) -> Column:
    """The point at length d along a line, its ends beyond them."""
    lengths = segment_lengths(line)
    start = F.struct(F.lit(0.0).alias("left"), F.lit(-1).alias("i"), F.lit(0.0).alias("t"), F.lit(0).alias("k"))

    def step(acc, l):
        # The first segment that reaches d is taken; zero-length ones never are.
        here = (acc["i"] < 0) & (l > 0) & (acc["left"] + l >= d)
        return F.struct((acc["left"] + l).alias("left"), F.when(here, acc["k"]).otherwise(acc["i"]).alias("i"), F.when(here, F.greatest((d - acc["left"]) / F.nullif(l, F.lit(0.0)), F.lit(0.0))).otherwise(acc["t"]).alias("t"), (acc["k"] + 1).alias("k"))

    def point(acc):
        a, b = line[acc["i"]], line[acc["i"] + 1]
        t = acc["t"]
        inside = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
        return F.when(acc["i"] >= 0, inside).otherwise(F.element_at(line, -1))

    return F.aggregate(lengths, start, step, point)


def samples(lines: DataFrame, key: str, step: float, line: str = "line") -> DataFrame:
    """Points in the middle of n = max(2, floor(length / step)) equal parts, with the heading between a metre before and
    a metre after (as a unit vector): key, i, n, x, y, hx, hy.

    Each segment finds the places that lie on it by arithmetic, so a line costs in proportion to its points and samples."""
    long = lines.where(F.size(line) >= 2).select(key, F.col(line).alias("_line")).withColumn("_len", segment_lengths(F.col("_line"))).withColumn("_sums", running_sums(F.col("_len")))
    n = F.size("_len")
    part = F.arrays_zip(F.slice("_line", F.lit(1), n).alias("a"), F.slice("_line", F.lit(2), n).alias("b"), F.slice("_sums", F.lit(1), n).alias("lo"), F.slice("_sums", F.lit(2), n).alias("hi"))
    total = F.element_at("_sums", -1)
    s = long.select(key, total.alias("total"), F.greatest(F.lit(2), F.floor(total / step)).cast("int").alias("n"), F.inline(part)).where((F.col("hi") > F.col("lo")) | (F.col("total") == 0))
    probes = F.explode(F.array(*(F.lit(d) for d in (0.0, -1.0, 1.0)))).alias("off")
    at = lambda d: (d - F.col("off")) * F.col("n") / F.nullif("total", F.lit(0.0)) - 0.5
    low = F.when(F.col("lo") <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor(at(F.col("lo"))) - 1))
    high = F.when(F.col("hi") >= F.col("total"), F.col("n") - 1).otherwise(F.least(F.col("n") - 1, F.ceil(at(F.col("hi"))) + 1))
    spread = s.select("*", probes).select("*", low.cast("int").alias("low"), high.cast("int").alias("high")).where("low <= high").withColumn("i", F.explode(F.sequence("low", "high")))
    spot = F.least(F.greatest(F.col("total") * (F.col("i") + 0.5) / F.col("n") + F.col("off"), F.lit(0.0)), F.col("total"))
    # The first segment that reaches the place has it; a line without length is its first point.
    rows = spread.withColumn("d", spot).where(((F.col("lo") < F.col("d")) | (F.col("lo") <= 0)) & (F.col("d") <= F.col("hi")))
    t = F.coalesce((F.col("d") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    place = F.struct((F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t).alias("x"), (F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t).alias("y"))
    of = lambda off: F.min(F.when(F.col("off") == off, F.struct("lo", place.alias("p"))))["p"]
    rows = rows.groupBy(key, "i", "n").agg(of(0.0).alias("p"), of(-1.0).alias("a"), of(1.0).alias("b"))
    size = _gap(F.col("a"), F.col("b"))
    unit = lambda c: F.when(size > 0, (F.col("b")[c] - F.col("a")[c]) / size).otherwise(F.lit(0.0))
    return rows.select(key, "i", "n", F.col("p")["x"].alias("x"), F.col("p")["y"].alias("y"), unit("x").alias("hx"), unit("y").alias("hy"))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0))))).otherwise(F.lit(0.0))
    return distance(px, py, ax + t * dx, ay + t * dy)


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def crosses(a: str, b: str) -> Column:
    """Whether the segments of two aliases (ax, ay, bx, by) cross at a point inside both."""
    c = lambda s, n: F.col(f"{s}.{n}")
    p, q, r, s = ((c(k, f"{e}x"), c(k, f"{e}y")) for k, e in ((a, "a"), (a, "b"), (b, "a"), (b, "b")))
    return (_turn(*p, *q, *r) * _turn(*p, *q, *s) < 0) & (_turn(*r, *s, *p) * _turn(*r, *s, *q) < 0)


def intersects(a: str, b: str) -> Column:
    """Whether the segments of two aliases have any point in common."""
    c = lambda s, n: F.col(f"{s}.{n}")
    p, q, r, s = ((c(k, f"{e}x"), c(k, f"{e}y")) for k, e in ((a, "a"), (a, "b"), (b, "a"), (b, "b")))
    on = lambda u, v, w: (_turn(*u, *v, *w) == 0) & (w[0].between(F.least(u[0], v[0]), F.greatest(u[0], v[0]))) & (w[1].between(F.least(u[1], v[1]), F.greatest(u[1], v[1])))
    return crosses(a, b) | on(p, q, r) | on(p, q, s) | on(r, s, p) | on(r, s, q)
