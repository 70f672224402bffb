"""python -m streetloom export|oneway|links|tiles [--area ID ...] [--cache URI] [--out URI] [--service URL]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .plans import export
from .sources import areas, documents, fetch


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """export builds and writes areas (all of them unless some are named); oneway and links enrich published ones; tiles
    only fetches the map tiles of the boxes in places.json."""
    ap = argparse.ArgumentParser(prog="streetloom", description=main.__doc__)
    ap.add_argument("what", choices=("export", "oneway", "links", "tiles"))
    ap.add_argument("--area", action="append", help="an area's id; may be given more than once")
    ap.add_argument("--cache", default="file:///tmp/streetloom/cache", help="uri of the downloaded files")
    ap.add_argument("--out", default="file:///tmp/streetloom/out", help="uri of the publication, with its places.json")
    ap.add_argument("--service", help="url of the map service; without it only cached tiles are read")
    a = ap.parse_args(argv)
    if a.what == "links" and not a.area:
        ap.error("links needs --area")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    chosen = [areas.area(areas.AREAS, i) for i in a.area] if a.area else list(areas.AREAS)
    spark = spark or SparkSession.builder.appName("streetloom").getOrCreate()
    if a.what == "export":
        return export.export(spark, export.Cache(a.cache), a.out, chosen, areas.AREAS)
    if a.what == "tiles":
        boxes = {r["id"]: tuple(r["bbox"]) for r in export.read_places(spark, a.out)["routed"]}
        return {x.id: [fetch.fetch_tile(a.service, fetch.oneway_query(box), fetch.tile_path(a.cache, f"{x.id}/oneway", box)) for box in documents.tile_boxes(*boxes[x.id])] for x in chosen}
    return export.enrich(spark, a.out, chosen, a.cache, a.what, a.service)


if __name__ == "__main__":
    main()
