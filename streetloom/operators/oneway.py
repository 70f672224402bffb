"""Directions of edges from one-way ways: sampling, matching, voting, repair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchParams
from ..functions import lines as L
from ..tables import materialise
from .components import repaired
from .grid import cell, segment_cells


def way_segments(ways: DataFrame, p: MatchParams, *carry: str) -> DataFrame:
    """Segments of ways (way_id, line) without degenerate ones, with unit headings: ax, ay, bx, by, sx, sy, and those of key
    columns asked for."""
    s = L.segments(ways, "way_id")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b))
    same = close("ax", "bx") & close("ay", "by") if p.legacy_degenerate else (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
    return s.where(~same).where("len > 0").select(*carry, "ax", "ay", "bx", "by", ((F.col("bx") - F.col("ax")) / F.col("len")).alias("sx"), ((F.col("by") - F.col("ay")) / F.col("len")).alias("sy"))


def match_directions(edges: DataFrame, ways: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """edges (eid, line, bridged), ways (way_id, line) -> (eid, direction) for edges that one-way ways agree on.

    Edge samples every step_m vote +1 or -1 by the ways that run within tolerance_m and max_angle_deg of them, or 0 where
    both directions do. An edge takes its commonest non-zero vote if min_coverage of its samples voted and min_agreement of
    these votes were that one. Estimated links and edges shorter than a metre don't take part."""
    usable = edges.where(~F.coalesce(F.col("bridged"), F.lit(False))).where(L.length(F.col("line")) >= 1).select("eid", "line")
    points = L.samples(usable, "eid", p.step_m).withColumn("cx", cell(F.col("x"), 4 * p.tolerance_m)).withColumn("cy", cell(F.col("y"), 4 * p.tolerance_m))
    near = points.join(segment_cells(way_segments(ways, p), 4 * p.tolerance_m, p.tolerance_m), ["cx", "cy"])
    gap = L.point_segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    cos = F.col("hx") * F.col("sx") + F.col("hy") * F.col("sy")
    hits = near.where((gap <= p.tolerance_m) & (F.abs(cos) >= math.cos(math.radians(p.max_angle_deg)))).select("eid", "i", "n", F.signum(cos).cast("int").alias("s"))
    votes = hits.groupBy("eid", "i", "n").agg(F.when(F.min("s") == F.max("s"), F.min("s")).otherwise(0).alias("vote"))
    tally = votes.groupBy("eid", "n").agg(F.count("*").alias("all"), *(F.count_if(F.col("vote") == v).alias(f"n{k}") for k, v in (("p", 1), ("m", -1), ("z", 0))))
    best = F.greatest("np", "nm")
    # A tie of both directions can't reach an agreement above one half.
    won = (best >= F.col("nz")) & (F.col("all") >= p.min_coverage * F.col("n")) & (best >= p.min_agreement * F.col("all"))
    return tally.where(won).select("eid", F.when(F.col("np") >= F.col("nm"), 1).otherwise(-1).alias("direction"))


def assign_oneway(edges: DataFrame, ways: DataFrame, p: MatchParams = MatchParams(), max_rounds: int = 20) -> DataFrame:
    """edges (eid, u, v, line, bridged) -> the same columns and oneway, turned into driving direction where one is kept.

    Directions that would cut the network into parts that can't reach each other are opened again. A turned edge swaps its
    ends, and its line is turned if its last point is closer to the new u, by the ends of the line as it was."""
    matched = materialise(match_directions(edges, ways, p), "oneway-matched")
    driven = edges.join(matched, "eid", "left")
    turned = F.col("direction") == -1
    ahead = driven.select("eid", F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"), F.col("direction").isNotNull().alias("oneway"))
    opened = repaired(ahead, max_rounds).withColumn("opened", F.lit(True))
    kept = driven.join(opened, "eid", "left").withColumn("oneway", F.col("direction").isNotNull() & F.col("opened").isNull())
    swap = F.col("oneway") & (F.col("direction") == -1)
    out = kept.withColumn("_u", F.when(swap, F.col("v")).otherwise(F.col("u"))).withColumn("_v", F.when(swap, F.col("u")).otherwise(F.col("v")))
    out = out.withColumn("line", F.when(swap, F.reverse("line")).otherwise(F.col("line"))).withColumn("u", F.col("_u")).withColumn("v", F.col("_v"))
    return out.select(*edges.columns, "oneway")


def oneway_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: matched, kept and reverted numbers of edges, from match_directions' and assign_oneway's results."""
    return before.agg(F.count("*").alias("matched")).crossJoin(after.agg(F.count_if("oneway").alias("kept"))).withColumn("reverted", F.col("matched") - F.col("kept"))  # a row each
