"""Shapefiles inside zip archives, filtered by member name: lines with their attributes."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shapes(raw: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The parts of each record of a .shp file of lines or polygons (with or without Z and M); None for empty shapes."""
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise ValueError("this is no shapefile")
    at = 100
    while at + 8 <= len(raw):
        words = struct.unpack(">i", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            yield None
            continue
        if kind not in (3, 5, 13, 15, 23, 25):
            raise ValueError(f"shapes of type {kind} are not lines or polygons")
        n_parts, n = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n]
        flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
        points = list(zip(flat[::2], flat[1::2], strict=True))
        yield [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def attributes(raw: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """The records of a .dbf file as text; blank values are None. Deleted records are kept, as shapes have theirs."""
    n, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at : at + 1] != b"\r":
        name = raw[at : at + 11].split(b"\0")[0].decode(encoding)
        fields.append((name, raw[at + 16]))
        at += 32
    for i in range(n):
        record, k = raw[head + i * size : head + (i + 1) * size], 1
        row = {}
        for name, width in fields:
            row[name] = record[k : k + width].decode(encoding, "replace").strip() or None
            k += width
        yield row


def _shp(lines: list[list[tuple[float, float]]]) -> bytes:
    body = b""
    for i, line in enumerate(lines):
        xs, ys = [p[0] for p in line], [p[1] for p in line]
        record = struct.pack("<i4d3i", 3, min(xs), min(ys), max(xs), max(ys), 1, len(line), 0) + b"".join(struct.pack("<2d", *p) for p in line)
        body += struct.pack(">2i", i + 1, len(record) // 2) + record
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8) + body


def _dbf(columns: dict[str, list[str]], encoding: str = "utf-8") -> bytes:
    raw = {n: [v.encode(encoding) for v in values] for n, values in columns.items()}
    width = {n: max([1, *map(len, values)]) for n, values in raw.items()}
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width[n], 0]) + b"\0" * 14 for n in raw)
    rows = [b" " + b"".join(raw[n][i].ljust(width[n]) for n in raw) for i in range(len(next(iter(raw.values()), [])))]
    return struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + len(head), 1 + sum(width.values())) + head + b"\r" + b"".join(rows)


def write_zip(members: dict[str, tuple[list, dict[str, list[str]]]]) -> bytes:
    """A zip of shapefiles of single lines: by member name without ending, the lines and the columns of text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, (lines, columns) in members.items():
            z.writestr(f"{name}.shp", _shp(lines))
            z.writestr(f"{name}.dbf", _dbf(columns))
    return out.getvalue()


def read_zip(raw: bytes, prefix: str = "") -> Iterator[tuple[str, dict[str, str | None], list]]:
    """(member, attributes, parts) of all shapefiles in a zip whose name starts with prefix."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(z.namelist()):
            if name.startswith(prefix) and name.lower().endswith(".shp"):
                for row, parts in zip(attributes(z.read(name[:-3] + "dbf")), shapes(z.read(name)), strict=True):
                    if parts is not None:
                        yield name, row, parts


def zipped_shapes(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Zips at path -> path, member, attrs (map) and line (array of x, y), a row per part; a task holds one zip at a time."""
    schema = "path string, member string, attrs map<string,string>, line array<struct<x:double,y:double>>"

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(where, name, attrs, [{"x": x, "y": y} for x, y in part]) for name, attrs, parts in read_zip(raw, prefix) for part in parts]
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["path", "member", "attrs", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, schema)


def face_table(zipped: DataFrame) -> DataFrame:
    """Block faces: face_id (by file, member and place), name and line, from the three name attributes."""
    from ..functions.text import street_name

    name = street_name(*(F.col("attrs")[c] for c in ("NM_TIP_LOG", "NM_TIT_LOG", "NM_LOG")))
    return zipped.select(F.xxhash64("path", "member", F.to_json("line")).alias("face_id"), name.alias("name"), "line")
