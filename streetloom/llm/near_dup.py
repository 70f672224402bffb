"""MinHash near-duplicate removal with SetSketch registers.

1. One pass over the texts turns each into its set of 5-word shingles, a 128-bit signature of the set and M registers.
   Register j holds the exponentially spaced, truncated minimum of the set under hash j:
   K = clip(floor(1 - log_b(x_min)), 0, q + 1), where x_min is the smallest of the set's exponential variates. Registers
   of a union are the larger ones of the parts' (`merge_registers`), and two sets agree in a register with a
   probability near their Jaccard similarity.
2. Equal sets form classes; only the smallest doc_id of a class goes on, so copies never become pairs.
3. Bands of register values give buckets. A bucket compares its smallest member, its centre, with all others (a star), not
   all pairs. A centre's star is the same in all buckets that it leads.
4. Before any text moves, a pair is dropped if the likelihood of the observed register order (greater, equal, less), given
   both cardinalities, makes the threshold implausible. The others are confirmed on the full sets.
5. Members that lie in different components after that are compared further, so a star loses no link. Members that are
   plausibly near their centre keep their residual, the symmetric difference of their set and the centre's. As
   |A ^ B| = |A ^ C| + |B ^ C| - 2 |(A ^ C) & (B ^ C)|, two residuals give the exact similarity of two members inside the
   join's condition, behind bounds by size and by the triangle inequality of Jaccard distances, so the join returns links
   only; only members outside the star's largest component start such pairs. Members of a bucket that are not near its
   centre meet all others there behind a bound on the registers that differ in some bits, inside the join, which lets
   through little more than step 4, and what passes goes through step 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import free
from .common import materialise, table
from .components import components
from .shingles import U, mix, shingle_sets, slices


@dataclass(frozen=True)
class NearDupParams:
    """Links need 100 * intersection >= percent * union. bands * rows registers are kept."""

    percent: int = 85
    bands: int = 24
    rows: int = 5
    base: float = 1.001
    #: Members of a star that are measured together, beside one copy of the centre's text.
    together: int = 256
    #: A candidate goes if twice the log-likelihood ratio against the threshold exceeds this (five standard deviations).
    reject: float = 25.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers_of(sets: list[np.ndarray], p: NearDupParams) -> np.ndarray:
    """The registers of non-empty sets: (n, registers) of uint16, at most 65535 = q + 1."""
    joined = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    factor = mix(np.arange(101, 101 + p.registers, dtype=U)) | U(1)
    low = np.empty((len(sets), p.registers), U)
    x = np.empty_like(joined)
    for j in range(p.registers):
        np.multiply(joined, factor[j], out=x)
        np.bitwise_xor(x, x >> U(32), out=x)
        x *= U(0xD6E8FEB86659FD93)
        low[:, j] = np.minimum.reduceat(x, at)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64)
    # Variates scaled by exp(-4) stay below 1, so K stays in 1..65535 for all that 64 bits can give.
    k = np.floor(1 - (np.log(np.maximum(least, 2.0**-65)) - 4.0) / np.log(p.base))
    return np.clip(k, 0, 65535).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, u: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray, base: float) -> np.ndarray:
    """Of similarity j, when `above` registers are greater in the first set, whose share of both cardinalities is u."""
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    hi, lo = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return above * np.log(np.maximum(hi, tiny)) + below * np.log(np.maximum(lo, tiny)) + equal * np.log(np.maximum(1 - hi - lo, tiny))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """Whether the threshold is plausible for pairs of register rows, and the maximum likelihood similarity."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = na / (na + nb)
    most = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0, 1, 201)[:, None] * most
    ll = log_likelihood(grid, u, above, below, equal, p.base)
    best = np.argmax(ll, 0)
    found = grid[best, np.arange(len(best))]
    goal = p.percent / 100
    at_goal = log_likelihood(np.minimum(goal, most), u, above, below, equal, p.base)
    keep = (most >= goal - 1e-12) & ((found >= goal) | (2 * (ll.max(0) - at_goal) <= p.reject))
    return keep, found


_SKETCH = "doc_id long, n_shingles long, sig1 long, sig2 long, regs binary, bits array<long>"


#: Bits kept of each register for comparisons inside a join.
PLANES = 4


def bits_of(regs: np.ndarray) -> np.ndarray:
    """PLANES bits of each register, packed into 64-bit words, plane after plane: equal registers have equal bits, others
    in one of 2**PLANES cases."""
    mixed = mix(regs.astype(U) + U(1))
    words = -(-regs.shape[1] // 64)
    padded = np.zeros((len(regs), PLANES, words * 64), np.uint8)
    for i in range(PLANES):
        padded[:, i, : regs.shape[1]] = (mixed >> U(63 - i)) & U(1)
    return np.packbits(padded, axis=2).reshape(len(regs), PLANES * words * 8).view(np.int64)


def differing(p: NearDupParams) -> str:
    """SQL for the number of registers whose bits differ between the rows x and y."""
    words = -(-p.registers // 64)
    either = lambda w: " | ".join(f"(x.bits[{i * words + w}] ^ y.bits[{i * words + w}])" for i in range(PLANES))
    return "(" + " + ".join(f"bit_count({either(w)})" for w in range(words)) + ")"


def most_differing(p: NearDupParams) -> int:
    """Registers whose bits differ in a pair at the threshold at most: beyond it twice the log-likelihood ratio exceeds
    p.reject, which by Chernoff's bound is rarer than exp(-p.reject / 2)."""
    q, n = (1 - p.percent / 100) * (1 - 0.5**PLANES), p.registers
    k = np.arange(int(np.ceil(n * q)), n + 1)
    x = np.minimum(k / n, 1 - 1e-12)
    ratio = 2 * n * (x * np.log(x / max(q, 1e-12)) + (1 - x) * np.log((1 - x) / (1 - q))) if q > 0 else np.where(k > 0, np.inf, 0.0)
    return int(k[ratio <= p.reject].max(initial=int(np.ceil(n * q))))


def sketch(documents: DataFrame, p: NearDupParams) -> DataFrame:
    """One row per document: its set's size, signature and registers (null registers for an empty set)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(shingle_sets(batch.column("text")))
                n = np.asarray([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                found = registers_of(full, p) if full else np.zeros((0, p.registers), np.uint16)
                regs, bits = iter(found), iter(bits_of(found).tolist())
                sums = np.asarray([[mix(s ^ U(c)).sum(dtype=U) for c in (0xA5A5A5A5, 0x3C3C3C3C3C)] for s in sets], U).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([next(bits) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "sig1", "sig2", "regs", "bits"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, _SKETCH)


def _plausible_pairs(pairs: DataFrame, classes: DataFrame, p: NearDupParams) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb")]
            keep, _ = plausible(*regs, *(batch.column(c).to_numpy().astype(float) for c in ("na", "nb")), p)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep))

    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(kernel, "a long, b long")


def _measured(pairs: DataFrame, docs: DataFrame, p: NearDupParams, residuals: bool = False) -> DataFrame:
    """Intersection and set sizes of pairs: a, b, both, na, nb; with residuals also the symmetric difference.

    Pairs with one a are cut into parts of about p.together, each with one copy of a's text ahead of those of its bs, so a
    hot a is spread over tasks and no text is copied for each pair."""
    names = ["a", "b", "both", "na", "nb", "residual"][: 5 + residuals]
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * residuals

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list = []
        begins = True
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list] = [[] for _ in names]
                for a, b, own in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                    if b is None:
                        heads = [*([] if begins else heads), own]
                        begins = False
                        continue
                    begins = True
                    for head in heads:
                        both = np.intersect1d(head, own, assume_unique=True)
                        row = [a, b, len(both), len(head), len(own)] + ([np.setxor1d(head, own, assume_unique=True).view(np.int64)] if residuals else [])
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.together).cast("int").alias("parts"))
    dealt = materialise(pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts"), "nd-dealt")
    ids = dealt.select(F.col("a").alias("doc_id")).union(dealt.select("b")).distinct()
    # Rows of one id with several texts are all measured, each with each.
    texts = materialise(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), "nd-texts")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text").unionByName(heads)
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text")
    found = materialise(rows.mapInArrow(kernel, "a long, b long, both long, na long, nb long" + ", residual array<long>" * residuals), "nd-measured")
    free(dealt, texts)
    return found


def _links_of_stars(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """The links (a, b) across components among rows (center, rep, comp, major, n, d, residual) of stars."""
    full = rows.withColumn("minor", F.col("comp") != F.col("major"))
    t = p.percent
    once = f"x.comp <> y.comp and (not y.minor or x.rep < y.rep) and 100 * least(x.n, y.n) >= {t} * greatest(x.n, y.n)"
    near = f"abs(x.d - y.d) <= {1 - t / 100 + 1e-9}"
    # 2 * intersection = x.n + y.n - |x ^ y|, and the union is x.n + y.n - intersection. The overlap of the residuals that
    # a link needs is bounded by the smaller one before the arrays are looked at.
    need = f"({2 * t} * (x.n + y.n) / {100 + t}.0D - (x.n + y.n) + size(x.residual) + size(y.residual)) / 2"
    linked = f"least(size(x.residual), size(y.residual)) >= {need} - 1e-6 and size(array_intersect(x.residual, y.residual)) >= {need} - 1e-6"
    exact = f"{100 + t} * (x.n + y.n - (size(x.residual) + size(y.residual) - 2 * size(array_intersect(x.residual, y.residual)))) >= {2 * t} * (x.n + y.n)"
    x, y = full.where("minor").alias("x"), full.alias("y")
    pairs = x.join(y, F.expr(f"x.center = y.center and {once} and {near} and {linked} and {exact}"))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(documents: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """documents (doc_id, text) -> one row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets. component_id is the smallest doc_id
    reachable by links, itself included; kept says that it is the document's own. Defined cases: a null, empty or
    white-space text has an empty set and is linked with nothing; equal texts of fewer than five words are linked;
    repeated rows give equal result rows; a doc_id with several texts has a row for each of them; a null doc_id takes
    no part and comes back with a null component_id and kept true; no rows give no rows; other columns are ignored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialise(sketch(docs, p), "nd-sketch")
    # The registers follow from the set, so grouping by them too keeps the aggregate a plain minimum.
    known = sketches.where("doc_id is not null and n_shingles > 0")
    classes = materialise(known.groupBy("sig1", "sig2", "n_shingles", "regs", "bits").agg(F.min("doc_id").alias("rep")), "nd-classes")

    width = 2 * p.rows
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("regs", 1 + i * width, width)) for i in range(p.bands)))
    banded = classes.select("rep", F.explode(keys).alias("key"))
    buckets = materialise(banded.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("size")).where("size > 1").drop("size"), "nd-buckets")
    met = materialise(banded.join(buckets, "key").where("rep <> center"), "nd-members")

    linked = F.expr(f"100 * both >= {p.percent} * (na + nb - both)")
    stars = met.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    likely = materialise(_plausible_pairs(stars, classes, p), "nd-likely")
    measured = _measured(likely, docs, p)
    found = measured.where(linked).select("a", "b")
    comps = components(found)

    # Stars whose members lie in several components; the centre itself has met all of them.
    named = comps.withColumnsRenamed({"v": "rep"})
    near = measured.select(F.col("a").alias("center"), F.col("b").alias("rep"), F.col("nb").alias("n"), (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("d"))
    near = materialise(near.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "nd-near")
    sizes = near.groupBy("center", "comp").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("center").agg(F.max(F.struct("n", "comp")).getField("comp").alias("major"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    open_ = materialise(near.join(open_, "center"), "nd-open")
    residuals = _measured(open_.select(F.col("center").alias("a"), F.col("rep").alias("b")), docs, p, residuals=True)
    full = materialise(open_.join(residuals.select(F.col("a").alias("center"), F.col("b").alias("rep"), "residual"), ["center", "rep"]), "nd-full")
    found = found.union(materialise(_links_of_stars(full, p), "nd-links"))

    # Members that are not near their bucket's centre meet the bucket's others.
    far = materialise(met.join(likely.select(F.col("a").alias("center"), F.col("b").alias("rep")), ["center", "rep"], "left_anti").select("key", "rep"), "nd-far")
    own = classes.select("rep", F.col("n_shingles").alias("n"), "bits").join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    beside = met.join(far.select("key").distinct(), "key", "left_semi").select("key", "rep")
    x, y = far.join(own, "rep").alias("x"), beside.join(far.withColumn("far", F.lit(True)), ["key", "rep"], "left").join(own, "rep").alias("y")
    alike = f"x.comp <> y.comp and (y.far is null or x.rep < y.rep) and 100 * least(x.n, y.n) >= {p.percent} * greatest(x.n, y.n) and {differing(p)} <= {most_differing(p)}"
    pairs = x.join(y, F.expr(f"x.key = y.key and {alike}")).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    pairs = materialise(_plausible_pairs(pairs, classes, p), "nd-likely")
    found = found.union(_measured(pairs, docs, p).where(linked).select("a", "b"))
    comps = components(found)

    # Every document to its class, every class to its component.
    named = classes.join(comps.withColumnsRenamed({"v": "rep"}), "rep", "left").select("sig1", "sig2", F.coalesce("comp", "rep").alias("component"))
    named = materialise(named, "nd-named")
    out = sketches.select("doc_id", "n_shingles", "sig1", "sig2").join(named, ["sig1", "sig2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


#: Exact links by shared shingles; the words are cut at the six bytes that separate them.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""
