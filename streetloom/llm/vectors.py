"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and compared inside their label only. Equal vectors form classes, of which one row goes on.
A label's rows are cut into tiles by the nearest of some pivots and their distance from it; a tile knows its least and
greatest distance from every pivot. By the triangle inequality tiles whose ranges lie too far apart for any one pivot need
not meet (unit vectors with cosine c are sqrt(2 - 2 c) apart). Each pair of tiles is one row of the join and one task's
work: an integer product of the int8 vectors estimates all cosines at once, with

    |cos(x, y) - s_x s_y <q_x, q_y>| <= e_x + e_y + e_x e_y,    e = |x / |x| - s q|

by the Cauchy-Schwarz inequality, since |s q| is at most 1 + e. Pairs that the bound leaves open are computed again in
double precision. A tile pair returns numbers of links and edges of a spanning forest, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .components import components


@dataclass(frozen=True)
class VectorParams:
    cosine: float = 0.98
    tile: int = 1024
    #: Pivots are taken from a bounded sample, each the furthest from those before it.
    pivots: int = 24
    sample: int = 2000


def comparable(e: Column) -> Column:
    """Vectors that are neither null nor zero and hold finite components only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return e.isNotNull() & F.forall(e, fine) & F.exists(e, lambda x: x != 0)


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales and error norms of unit vectors; the norms are rounded up."""
    scale = np.maximum(np.abs(u).max(1), 1e-300) / 127
    q = np.rint(u / scale[:, None])
    error = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-12) + 1e-14
    return q.astype(np.int8), scale, error


#: Numbers in one array of a worker at most, 1 MB of doubles.
_AT_ONCE = 1 << 17


def links(x: np.ndarray, qx: tuple, y: np.ndarray, qy: tuple, cosine: float) -> np.ndarray:
    """Which rows of two tiles of raw double vectors are linked, as a boolean matrix; also see `exact_cosine`.

    Some rows of x at a time meet all of y, and some doubtful pairs at a time are computed again, so that beside the
    matrix no array has more than _AT_ONCE numbers, or one row of x and y, however many pairs are in doubt."""
    (a, sa, ea), (b, sb, eb) = qx, qy
    # Products of int8 sum exactly in single precision up to 2**24, that is 1040 dimensions; beyond, in double.
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    bt, out = b.astype(kind).T, np.zeros((len(a), len(b)), bool)
    rows, pairs = max(1, _AT_ONCE // max(1, len(b))), max(1, _AT_ONCE // max(1, a.shape[1]))
    for r in range(0, len(a), rows):
        at = slice(r, r + rows)
        guess = (a[at].astype(kind) @ bt).astype(np.float64)
        guess *= sa[at, None]
        guess *= sb[None]
        guess += ea[at, None] + eb[None] + ea[at, None] * eb[None] + 1e-12
        i, j = np.nonzero(guess >= cosine)
        i += r
        for k in range(0, len(i), pairs):
            m, n = i[k : k + pairs], j[k : k + pairs]
            out[m, n] = exact_cosine(x[m], y[n]) >= cosine
    return out


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; rows are scaled by their largest component first, so none overflows."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of local vertices 0..n-1."""
    root, out = list(range(n)), []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for k in range(0, len(i), 1 << 14):
        for a, b in zip(i[k : k + (1 << 14)].tolist(), j[k : k + (1 << 14)].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def packed(x: np.ndarray) -> bytes:
    """Double rows in single precision where that loses nothing, so that tiles travel in half the bytes."""
    with np.errstate(over="ignore"):
        half = x.astype("<f4")
    return (half if np.array_equal(half, x) else x.astype("<f8")).tobytes()


def unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"<f{len(raw) // (n * dim)}").astype(np.float64).reshape(n, dim)


def near_vectors(embeddings: DataFrame, p: VectorParams = VectorParams()) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and their vectors' cosine reaches p.cosine. Defined cases: rows with a
    null label or a vector that is null, empty or zero or holds null or non-finite components have no links and are kept;
    vectors of different lengths are not linked; rows with equal vectors are linked with each other; a vec_id that occurs
    repeatedly counts as often as it occurs, and its rows come back alike; rows with a null vec_id have no links, a null
    component_id, and are kept; an empty table gives no rows; other columns are ignored."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    fit = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("e")))
    # -0.0 and 0.0 are one value. A class is known by its smallest id and carries its number of rows.
    fit = fit.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    classes = materialise(fit.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vec-classes")

    pivots = _pivots(classes, p)
    tiles = materialise(_tiled(materialise(_placed(classes, pivots), "vec-placed"), pivots, p), "vec-tiles")
    edges, counts = _tile_links(tiles, p)
    comps = components(edges)

    near = counts.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.join(near, "rep", "left").join(comps.withColumnsRenamed({"v": "rep"}), "rep", "left")
    named = materialise(named.select("label", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id")), "vec-named")
    plus = rows.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))
    out = plus.join(named, ["label", "e"], "left")
    alone = F.col("vec_id").isNull() | F.col("component_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    n_links = F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: What rounding may add to a distance between unit vectors.
_SLACK = 1e-6


def _pivots(classes: DataFrame, p: VectorParams) -> dict[int, np.ndarray]:
    """For each vector length in a bounded sample some unit vectors that lie far apart. Any pivots give right results, and
    so do none."""
    by_dim: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("rep")).limit(p.sample).select("e").collect():
        by_dim.setdefault(len(r.e), []).append(r.e)
    found = {}
    for dim, got in by_dim.items():
        u = unit(np.asarray(got))
        chosen, least = [0], distances(u, u[:1])[:, 0]
        while len(chosen) < p.pivots and least.max() > 0.1:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, distances(u, u[chosen[-1:]])[:, 0])
        found[dim] = u[chosen]
    return found


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between unit vectors, to _SLACK."""
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def _placed(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """classes with dim, the number of the nearest pivot and the distance from it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            offsets, values = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False)
            dims, nearest, far = np.diff(offsets).astype(np.int32), np.zeros(len(e), np.int32), np.zeros(len(e))
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    for i in np.array_split(at, -(-len(at) * dim // 1_000_000)):
                        d = distances(unit(values[offsets[i][:, None] + np.arange(dim)]), pivots[dim])
                        nearest[i], far[i] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(nearest), pa.array(far)], names=[*batch.schema.names, "dim", "pivot", "far"])

    return classes.mapInArrow(kernel, T.StructType([*classes.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("pivot", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def _tiled(placed: DataFrame, pivots: dict[int, np.ndarray], p: VectorParams) -> DataFrame:
    """One row per tile: label, dim, tile, least and greatest distances from the pivots, and the packed rows.

    Tiles are runs of about p.tile rows of a label and pivot in the order of their distance from it. A histogram of fine
    cells gives the runs, so no label is sorted in one task; a cell that alone exceeds a tile is dealt on by hash."""
    cells = 1 << 13
    cut = placed.withColumn("cell", F.floor(F.col("far") * (cells / 2)).cast("int"))
    counts = cut.groupBy("label", "dim", "pivot", "cell").agg(F.count("*").alias("n"))
    # At most `cells` rows per label and pivot meet in this window.
    before = F.sum("n").over(W.partitionBy("label", "dim", "pivot").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    starts = materialise(counts.select("label", "dim", "pivot", "cell", F.floor(before / p.tile).cast("int").alias("run"), F.ceil(F.col("n") / p.tile).cast("int").alias("parts")), "vec-cells")
    dealt = cut.join(starts, ["label", "dim", "pivot", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        x = np.stack(pdf["e"].to_numpy()).astype("<f8")
        u, one = unit(x), pdf.iloc[0]
        d = distances(u, pivots[x.shape[1]]) if x.shape[1] in pivots else np.zeros((len(x), 0))
        raw = {"ids": pdf["rep"].to_numpy("<i8"), "copies": pdf["copies"].to_numpy("<i8"), "x": x}
        return pd.DataFrame({"label": [one["label"]], "dim": [one["dim"]], "lo": [d.min(0)], "hi": [d.max(0)], **{k: [packed(v) if k == "x" else v.tobytes()] for k, v in raw.items()}})

    schema = "label string, dim int, lo array<double>, hi array<double>, ids binary, copies binary, x binary"
    tiles = dealt.select("label", "dim", "pivot", "run", "part", "rep", "copies", "e").groupBy("label", "dim", "pivot", "run", "part").applyInPandas(pack, schema)
    return tiles.withColumn("tile", F.monotonically_increasing_id())


_PACKED = ("ids", "copies", "x")


def _tile_links(tiles: DataFrame, p: VectorParams) -> tuple[DataFrame, DataFrame]:
    """Forest edges (a, b) and numbers of links (rep, n) of all pairs of tiles that can hold a link."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):

                def side(s: str, r=r):
                    get = lambda k, t: np.frombuffer(getattr(r, f"{s}_{k}"), t)
                    ids = get("ids", "<i8")
                    x = unpacked(getattr(r, f"{s}_x"), len(ids), r.dim)
                    return ids, get("copies", "<i8"), x, quantise(unit(x))

                ia, ca, xa, qa = side("l")
                ib, cb, xb, qb = side("r")
                hit = links(xa, qa, xb, qb, p.cosine)
                if r.l_tile == r.r_tile:
                    hit &= ~np.eye(len(ia), dtype=bool)
                    i, j = np.nonzero(np.triu(hit))
                    n = [(ia, hit @ cb)]
                    edges = [(ia[a], ia[b]) for a, b in _forest(i, j, len(ia))]
                else:
                    i, j = np.nonzero(hit)
                    n = [(ia, hit @ cb), (ib, ca @ hit)]
                    both = np.concatenate([ia, ib])
                    edges = [(both[a], both[b]) for a, b in _forest(i, j + len(ia), len(both))]
                out = [pd.DataFrame({"a": ids[k > 0], "b": k[k > 0], "edge": False}) for ids, k in n]
                if edges:
                    out.append(pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "edge": True}))
                yield pd.concat(out, ignore_index=True)

    reach = float(np.sqrt(max(0.0, 2 - 2 * p.cosine)) + 2 * _SLACK)
    side = lambda s: tiles.select("label", "dim", *(F.col(c).alias(f"{s}_{c}") for c in ("tile", "lo", "hi")))
    apart = lambda lo, hi: F.exists(F.zip_with(lo, hi, lambda a, b: a > b + reach), lambda x: x)
    near = side("l").join(side("r"), ["label", "dim"]).where((F.col("l_tile") <= F.col("r_tile")) & ~apart("l_lo", "r_hi") & ~apart("r_lo", "l_hi"))
    load = lambda s: tiles.select(F.col("tile").alias(f"{s}_tile"), *(F.col(c).alias(f"{s}_{c}") for c in _PACKED))
    near = materialise(near.select("dim", "l_tile", "r_tile"), "vec-pairs")
    pairs = near.join(load("l"), "l_tile").join(load("r"), "r_tile")
    # About eight pairs of tiles for each task.
    spread = pairs.repartition(max(1, min(100_000, near.count() // 8 + 1)), "l_tile", "r_tile")
    met = materialise(spread.mapInPandas(meet, "a long, b long, edge boolean"), "vec-links")
    return met.where("edge").select("a", "b"), met.where("not edge").select(F.col("a").alias("rep"), F.col("b").alias("n"))


def op9_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
