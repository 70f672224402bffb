"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into ranges of a fixed number of rows. Each range holds, for every dimension, its rows sorted by that
component. A query reads the lists of its non-zero dimensions, from the end where its products are large, a few entries at
a time and first those lists where that lowers the bound most; it scores each row that it meets for the first time, and
stops when the sum of the products at the depths that it has read to cannot beat its kth score. A range stays with its
task, where groups of queries come by; queries carry their kth score from one range to the next. Each visit returns the k
best rows at most; a window keeps the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    #: Queries are the rows whose id is divisible by this.
    every: int = 20
    scale: int = 64
    #: Rows of a range, and of a group of queries at most; groups are smaller where there are too few tasks.
    range_rows: int = 16_384
    #: Ranges that one task visits with the same queries, where there are many.
    visits: int = 8
    #: Entries read from a list at first; each further time three times as many.
    step: int = 8


def usable(column: Column) -> Column:
    """Vectors without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return column.isNotNull() & F.forall(column, fine)


class Block:
    """Rows of candidates with their sorted lists; scores are exact integers in single or double precision."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        self.small = self.x.astype(np.float32)
        self.most = np.abs(self.x).max(0) if len(x) else np.zeros(x.shape[1])
        self.lists = np.argsort(self.x.T, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.x.T, self.lists, axis=1)

    def rows_for(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and query in the smallest precision that gives exact scores: all sums of integers below 2**24 in single."""
        return (self.small, q.astype(np.float32)) if self.most @ np.abs(q) < 1 << 24 else (self.x, q)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 2 * k:  # what is below the kth score needs no sort; its ties stay in
        most = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[most], scores[most]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(block: Block, q: np.ndarray, own: int, k: int, kth: float = -np.inf, step: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best rows of a block for a query, by score and then smaller id, and how many rows were scored; rows below
    `kth`, known from elsewhere, may be left out."""
    n = len(block.ids)
    dims = np.flatnonzero(q)
    if len(dims) == 0:
        rest = np.flatnonzero(block.ids != own)[:k]
        return block.ids[rest], np.zeros(len(rest)), len(rest)
    weight, up = q[dims], q[dims] < 0
    x, q = block.rows_for(q)
    ids, scores = np.zeros(0, np.int64), np.zeros(0)
    unseen = block.ids != own
    left = int(unseen.sum())
    scored, depth, ahead = 0, np.zeros(len(dims), np.int64), np.full(len(dims), step)
    # The products at the depths read to: the most that a row can score that no list has shown yet.
    at = lambda d: weight * block.sorted[dims, np.where(up, np.minimum(d, n - 1), np.maximum(n - 1 - d, 0))]
    front = at(depth)
    while left:
        floor = max(kth, scores[-1]) if len(scores) == k else kth
        # A row that ties with the kth score may still win by its id.
        if front.sum() < floor:
            break
        to = np.minimum(n, depth + ahead)
        lower = at(to)
        gain = front - lower
        # The lists that lower the bound most, at least half as much as the best; where none does, all look further ahead.
        open_ = depth < n
        most = gain[open_].max()
        if most <= 0 and (to[open_] < n).any():
            ahead *= 4
            continue
        read = np.flatnonzero(open_ & (gain >= most / 2)) if most > 0 else np.flatnonzero(open_)[:1]
        met = np.concatenate([block.lists[dims[j], depth[j] : to[j]] if up[j] else block.lists[dims[j], n - to[j] : n - depth[j]] for j in read.tolist()])
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= unseen
        rows = np.flatnonzero(fresh)
        if len(rows):
            unseen[rows] = False
            left -= len(rows)
            scored += len(rows)
            s = (x[rows] @ q).astype(np.float64)
            fit = s >= floor
            ids, scores = _best(np.concatenate([ids, block.ids[rows[fit]]]), np.concatenate([scores, s[fit]]), k)
        depth[read], front[read] = to[read], lower[read]
        ahead[read] *= 3
    return ids, scores, scored


#: Forms of packed numbers, the smallest that holds a block exactly is taken.
_FORMS = ("<i1", "<i2", "<i4", "<f8")


def _pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (vec_id, dim, v) into blocks of at most about `size` rows of one length: (dim, b, ids, form, x).

    Rows are dealt by a hash, as many buckets as the length's row count asks for, so a block is bounded at any size."""
    blocks = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("blocks"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        x = np.stack(pdf["v"].to_numpy()).astype("<f8") if dim else np.zeros((len(pdf), 0))
        form = next(f for f in _FORMS if f == "<f8" or (x == x.astype(f)).all())
        return pd.DataFrame({"dim": [dim], "b": pdf["b"].iloc[:1], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "form": [form], "x": [x.astype(form).tobytes()]})

    dealt = rows.join(blocks, "dim").withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).drop("blocks")
    return materialise(dealt.groupBy("dim", "b").applyInPandas(pack, "dim int, b int, ids binary, form string, x binary"), name)


def _unpack(ids: bytes, form: str, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(x, form).reshape(len(i), dim).astype(np.float64)


def top_k(embeddings: DataFrame, p: TopKParams = TopKParams()) -> DataFrame:
    """embeddings (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k best other rows.

    Scores are integer inner products of floor(scale * component), ties go to the smaller vec_id. Defined cases: rows with
    a null id, a null vector or a null or non-finite component take no part; vectors of another length than the query's
    are no candidates of it; a repeated vec_id is a candidate as often as it occurs, but not of a query with the same id,
    and is one query (its smallest vector); a zero vector is a query whose scores are all 0; fewer candidates than k
    give fewer rows; no rows give no rows; other columns are ignored. Scores are exact while they stay below 2**53, which
    holds for components below a million in a thousand dimensions; beyond, they are rounded to double precision."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    vectors = materialise(vectors.select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * float(p.scale)).cast("double")).alias("v")), "topk-vectors")
    queries = vectors.where(F.col("vec_id") % p.every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).groupBy("vec_id").agg(F.min_by("v", "v").alias("v")).withColumn("dim", F.size("v"))
    queries = materialise(queries, "topk-queries")
    ranges = _pack(vectors, p.range_rows, "topk-ranges")
    # As many groups of queries as give each core some tasks, and more if a group would be larger than a range.
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    n_ranges, n_queries = ranges.count(), queries.count()
    group_rows = min(p.range_rows, max(64, -(-n_queries * max(1, n_ranges) // tasks)))
    found = _search_blocks(ranges, _pack(queries, group_rows, "topk-groups"), p)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _search_blocks(ranges: DataFrame, groups: DataFrame, p: TopKParams) -> DataFrame:
    """All groups of queries against all ranges of their length: a stated query set against every row, in blocks."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, here = (None, None), (None, None)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if group[0] != (r.dim, r.g):
                    qi, qx = _unpack(r.qids, r.qform, r.qx, r.dim)
                    group = ((r.dim, r.g), qi, qx, np.full(len(qi), -np.inf))
                if here[0] != (r.dim, r.b):
                    here = ((r.dim, r.b), Block(*_unpack(r.ids, r.form, r.x, r.dim)))
                _, qi, qx, kth = group
                out: tuple[list, list, list] = ([], [], [])
                for i in range(len(qi)):
                    ids, scores, _ = search(here[1], qx[i], qi[i], p.k, kth[i], p.step)
                    if len(ids) == p.k:
                        kth[i] = max(kth[i], scores[-1])
                    for column, part in zip(out, (np.full(len(ids), qi[i]), ids, scores), strict=True):
                        column.append(part)
                if out[0]:
                    query, ids, scores = map(np.concatenate, out)
                    yield pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores.astype(np.int64)})

    left = groups.select("dim", F.col("b").alias("g"), F.col("ids").alias("qids"), F.col("form").alias("qform"), F.col("x").alias("qx"))
    # Numbers of ranges and groups meet first and the payloads follow by equi-joins, so neither side need fit in memory.
    numbers = materialise(ranges.select("dim", "b").join(left.select("dim", "g"), "dim"), "topk-pairs")
    pairs = numbers.count()
    visits = min(p.visits, max(1, pairs // (8 * numbers.sparkSession.sparkContext.defaultParallelism)))
    # A task's rows are worked on one by one, in the order of groups.
    dealt = numbers.join(ranges, ["dim", "b"]).join(left, ["dim", "g"]).withColumn("part", F.floor(F.col("b") / visits).cast("int"))
    dealt = dealt.repartition(max(1, min(100_000, pairs // visits)), "dim", "g", "part").sortWithinPartitions("dim", "g", "part", "b")
    return dealt.mapInPandas(visit, "query_id long, vec_id long, score long")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
