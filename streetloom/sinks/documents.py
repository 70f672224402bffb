"""Graphs and places as compact JSON documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators.roads import dense_ids
from ..sources.fetch import write_bytes
from ..tables import materialise


def name_index(edges: DataFrame) -> DataFrame:
    """(name, idx): names numbered by their first edge."""
    first = edges.groupBy("name").agg(F.min("eid").alias("first"))
    return dense_ids(first, "first", "idx").select("name", "idx")


def _in_order(value: Column, order: str) -> Column:
    """The values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def graph_payload(nodes: DataFrame, edges: DataFrame, code: str, name: str, municipalities: list[int], source: str, crs: str, params: dict[str, float], notes: dict[str, str] | None = None) -> DataFrame:
    """One row `payload` (JSON text) for an area's nodes (id, lon, lat) and edges (eid, u, v, length, name, line, bridged).

    Positions are rounded to five decimals and lengths to decimetres, halves to even; ids must be dense. Edges with a
    column oneway add its list, and notes further attributes (directionSource, linkSource). The document is one area's, so
    it is put together in one task; the tables of many areas are written by many calls."""
    flat_nodes = nodes.agg(F.flatten(_in_order(F.array(F.bround("lon", 5), F.bround("lat", 5)), "id")).alias("nodes"))
    index = name_index(edges)
    listed = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("eid")))).alias(flag)
    flags = [c for c in ("bridged", "oneway") if c in edges.columns]
    e = edges.join(index, "name").agg(
        F.flatten(_in_order(F.array("u", "v", L.quantised(F.col("length")), "idx"), "eid")).alias("edges"),
        _in_order(L.flat(F.col("line")), "eid").alias("lines"),
        *map(listed, flags),
    )
    names = index.agg(_in_order(F.col("name"), "idx").alias("names"))
    one = flat_nodes.crossJoin(e).crossJoin(names)  # a row each
    head = [F.struct(F.lit(code).alias("code"), F.lit(name).alias("name")).alias("municipality"), F.array(*(F.lit(int(m)) for m in municipalities)).alias("municipalities"), F.lit(source).alias("source"), F.lit(crs).alias("crs"), F.create_map(*(F.lit(x) for kv in sorted(params.items()) for x in kv)).alias("params")]
    return one.select(F.to_json(F.struct(*head, "nodes", "edges", "lines", "names", *flags, *(F.lit(v).alias(k) for k, v in (notes or {}).items()))).alias("payload"))


def payload_box(payloads: DataFrame) -> DataFrame:
    """(path, bbox) of payload rows (path, nodes)."""
    n = F.size("nodes")
    xs = F.filter("nodes", lambda x, i: i % 2 == 0)
    ys = F.filter("nodes", lambda x, i: i % 2 == 1)
    return payloads.where(n > 0).select("path", F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("bbox"))


def feature(coordinates: Column, kind: Column, **properties: Column) -> Column:
    """A GeoJSON feature; coordinates is a nested array column."""
    return F.struct(F.lit("Feature").alias("type"), F.struct(*(v.alias(k) for k, v in properties.items())).alias("properties"), F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"))


def feature_collections(features: DataFrame, by: str, order: str) -> DataFrame:
    """(by, json): a document for each group of features (by, order, feature); groups without rows have none."""
    return features.groupBy(by).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), _in_order(F.col("feature"), order).alias("features"))).alias("json"))


_COORDINATES = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>", "LineString": "array<array<double>>", "Point": "array<double>"}


def _rounded(x: Column, depth: int, digits: int) -> Column:
    return F.bround(x, digits) if depth == 0 else F.transform(x, lambda y: _rounded(y, depth - 1, digits))


def geometry_text(kind: Column, coordinates: Column, digits: int = 5) -> Column:
    """A geometry as compact JSON with rounded coordinates, from the JSON text of its coordinates, of the usual kinds."""
    out = F.lit(None).cast("string")
    for name, form in _COORDINATES.items():
        body = F.to_json(_rounded(F.from_json(coordinates, form), form.count("<"), digits))
        out = F.when(kind == name, F.concat(F.lit(f'{{"type":"{name}","coordinates":'), body, F.lit("}"))).otherwise(out)
    return out


def geometry_box(coordinates: Column, digits: int = 5) -> Column:
    """[x0, y0, x1, y1], rounded, of the JSON text of coordinates, however deeply nested."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    axis = lambda k: F.transform(F.regexp_extract_all(coordinates, F.lit(rf"\[\s*{number}\s*,\s*{number}"), k), lambda x: x.cast("double"))
    return F.array(*(F.bround(f(axis(k)), digits) for f, k in ((F.array_min, 1), (F.array_min, 2), (F.array_max, 1), (F.array_max, 2))))


def collection_texts(features: DataFrame, by: str, order: str, *properties: str) -> DataFrame:
    """(by, json) of features (by, order, kind, coordinates as JSON text, properties): a document for each group; a group
    without features has none."""
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), geometry_text(F.col("kind"), F.col("coordinates")), F.lit("}"))
    body = F.array_join(_in_order(feature, order), ",")
    return features.groupBy(by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("json"))


def write_documents(docs: DataFrame, uri: str, name: str, json: str = "json") -> DataFrame:
    """Write each row's text to its own file uri/name; returns (name, chars), with the number of characters, not bytes.

    Files are written by the tasks, beside their place and then renamed, so a task that runs again does no harm."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for file, text in zip(names, texts, strict=True):
                write_bytes(f"{uri.rstrip('/')}/{file}", text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64())], names=[name, "chars"])

    return materialise(docs.select(name, json).mapInArrow(kernel, f"{name} string, chars long"), "documents-written")


def merged_places(old: DataFrame, rebuilt: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of areas that were not rebuilt with those that were, in catalogue order: id, and the other columns."""
    kept = old.join(rebuilt.select("id"), "id", "left_anti")
    return kept.unionByName(rebuilt).join(catalogue.select("id", "ordinal"), "id").orderBy("ordinal").drop("ordinal")
