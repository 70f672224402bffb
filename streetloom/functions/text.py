"""Names and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(text: Column) -> Column:
    """Each run of letters with a capital first and the rest small, whatever stands between the runs."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def street_name(*parts: Column) -> Column:
    """The parts that are neither null nor blank, trimmed, in title case, joined by a space."""
    return F.concat_ws(" ", *(title(F.nullif(F.trim(p), F.lit(""))) for p in parts))


def first_filled(*parts: Column) -> Column:
    """The first part that is neither null nor empty, or an empty string."""
    return F.coalesce(*(F.nullif(p, F.lit("")) for p in parts), F.lit(""))


def direction(tags: Column) -> Column:
    """1 along the way, -1 against it, 0 both ways, from the tags oneway, junction and highway."""
    oneway = F.lower(F.coalesce(tags["oneway"], F.lit("")))
    ring = F.coalesce(tags["junction"], F.lit("")).isin("roundabout", "circular")
    motorway = F.coalesce(tags["highway"], F.lit("")) == "motorway"
    return F.when(oneway.isin("yes", "1", "true"), 1).when(oneway.isin("-1", "reverse"), -1).when(oneway == "no", 0).when(ring | motorway, 1).otherwise(0)


def is_road(tags: Column, classes: tuple[str, ...]) -> Column:
    """Drivable classes that are no areas and not closed to the public; absent tags pass."""
    get = lambda k: F.coalesce(tags[k], F.lit(""))
    return get("highway").isin(*classes) & (get("area") != "yes") & ~get("access").isin("private", "no")


def maybe_oneway(tags: Column) -> Column:
    """Ways that the one-way query asks for."""
    get = lambda k: F.coalesce(tags[k], F.lit(""))
    implied = get("junction").isin("roundabout", "circular") | (get("highway") == "motorway")
    return (get("highway") != "") & (get("oneway").isin("yes", "1", "true", "-1", "reverse") | (implied & (get("oneway") != "no")))
