"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess is shared again by weight. Training time runs from 0 to 1. Each source has a
weight schedule over it, piecewise linear between knots; its integral, scaled to the target, is the source's cumulative
token demand. A source's documents stand in a fixed hash order, repeated up to twice; the cumulative words in front of a
document are put into the inverse of the demand curve, which gives the document's training position, and documents are
range-sorted by it.

Cumulative words of a hot source never meet in one task: equal rows are counted first, the rest falls into hash buckets of
about a thousand rows and these into groups of buckets. Sums are added up by group, then by bucket, and only the order
inside a bucket needs a window over rows. Sources are a table as well, of any number, whose targets come from rounds of
aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.roads import dense_ids
from .common import materialise, table, word_count


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    repeat: float = 2.0
    #: Weight at times 0, 1/2 and 1, by source in the same repeating order.
    schedules: tuple[tuple[float, float, float], ...] = ((1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (0.5, 1.0, 2.0))
    bucket_rows: int = 1024
    group_buckets: int = 1024


def fill(sources: DataFrame, total: float, repeat: float) -> DataFrame:
    """sources (size, weight and others) with `target`: shares of total by weight, none above repeat times its size.

    What is cut off is shared again by weight among the others, until none is above; a round closes all sources that its
    share would fill, so there are few. Sums of sizes and weights are whole numbers, which add up alike in any order."""
    cap = repeat * F.col("size")
    state, level = sources, None
    while True:
        closed = F.lit(False) if level is None else F.col("weight") * level > cap
        open_weight, used, n = state.agg(F.coalesce(F.sum(F.when(~closed, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(closed, cap)), F.lit(0.0)), F.count_if(closed)).first()
        if level is not None and n == shut:
            break
        shut = n
        if open_weight <= 0:
            break
        level = (total - used) / open_weight
    level = 0.0 if level is None else level
    return sources.withColumn("target", F.when(F.col("weight") * level > cap, cap).otherwise(F.col("weight") * level))


def demand(schedule: Column, t: Column) -> Column:
    """The integral of a schedule (weights at 0, 1/2, 1) from 0 to t."""
    a, b, c = (schedule[i] for i in range(3))
    part = lambda p, q, x: p * x + (q - p) * x * x  # noqa: E731  from a knot to x after it, knots half apart
    return F.when(t <= 0.5, part(a, b, t)).otherwise(part(a, b, F.lit(0.5)) + part(b, c, t - 0.5))


def position(schedule: Column, share: Column) -> Column:
    """The time at which this share of the whole integral is reached: the inverse of demand."""
    a, b, c = (schedule[i] for i in range(3))
    first = (a + b) / 4
    want = share * demand(schedule, F.lit(1.0))

    def root(p, q, y):
        # p x + (q - p) x^2 = y, in the form that stays exact for p = q.
        return 2 * y / (p + F.sqrt(F.greatest(p * p + 4 * (q - p) * y, F.lit(0.0))))

    return F.when(want <= first, F.when(want <= 0, F.lit(0.0)).otherwise(root(a, b, want))).otherwise(F.least(0.5 + root(b, c, want - first), F.lit(1.0)))


def mix(documents: DataFrame, p: MixParams = MixParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, source, text) -> doc_id, source, size, source_size, target, taken, position, second_position.

    size is the text's number of words; taken the words that the mix takes, repeats counted: a source's documents are
    read in hash order until its target, rounded to words, is used up, so the document at the end is taken in part and
    the sums meet the targets. position is the training time of the first copy, second_position that of the second, null
    if there is none. The rows come sorted by position.

    Defined cases: a null source is a source of its own, after the others; a null or empty text has size 0 and takes
    nothing; a null doc_id is hashed as an empty id, or by the columns in carry if there are any; rows with one doc_id are
    ordered by size, and equal rows may share words between them in either way; all sizes 0 give targets 0; an empty table
    gives no rows; other columns are ignored, but for those named in carry, which come back too and order equal rows."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(",", *(F.col(c).cast("string") for c in carry)) if carry else F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *carry)
    docs = docs.withColumn("h", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"))
    # A narrow written table: the texts are read once for any number of passes below. Equal rows become one with a number.
    docs = materialise(docs.groupBy("doc_id", "source", "size", "h", *carry).agg(F.count("*").alias("copies")), "mix-sizes")

    sources = docs.groupBy(F.col("source").alias("src")).agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"))
    sources = materialise(dense_ids(sources.withColumn("k", F.struct(F.col("src").isNull(), "src")), "k", "i").drop("k"), "mix-sources")
    of = lambda values: F.element_at(values, (F.col("i") % F.size(values) + 1).cast("int"))
    weights = F.array(*(F.lit(float(w)) for w in p.weights))
    schedules = F.array(*(F.array(*(F.lit(float(x)) for x in shape)) for shape in p.schedules))
    sources = sources.select("src", "size", F.greatest(F.lit(1), F.ceil(F.col("rows") / p.bucket_rows)).alias("parts"), of(weights).alias("weight"), of(schedules).alias("schedule"))
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    plan = materialise(fill(sources, p.share * total, p.repeat).select("src", F.col("size").alias("source_size"), "target", "parts", "schedule"), "mix-plan")

    width = F.ceil(F.lit(float(1 << 60)) / F.col("parts")).cast("long")
    placed = docs.join(plan, docs["source"].eqNullSafe(plan["src"])).drop("src").withColumn("bucket", F.floor(F.col("h") / width).cast("long")).withColumn("group", F.floor(F.col("bucket") / p.group_buckets))
    words = F.col("size") * F.col("copies")
    per_bucket = materialise(placed.groupBy("source", "group", "bucket").agg(F.sum(words).alias("inside")), "mix-buckets")
    per_group = per_bucket.groupBy("source", "group").agg(F.sum("inside").alias("n"))
    # A row for each million documents of a source, and then for each thousand of a group, meets in a window.
    groups = per_group.select(F.col("source").alias("src"), F.col("group").alias("g"), (F.sum("n").over(W.partitionBy("source").orderBy("group")) - F.col("n")).alias("base"))
    within = F.sum("inside").over(W.partitionBy("source", "group").orderBy("bucket")) - F.col("inside")
    before = per_bucket.withColumn("within", within).join(groups, F.col("source").eqNullSafe(F.col("src")) & (F.col("group") == F.col("g")))
    before = materialise(before.select(F.col("source").alias("src"), F.col("bucket").alias("b"), (F.col("base") + F.col("within")).alias("ahead")), "mix-ahead")
    run = F.sum(words).over(W.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", *carry).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = placed.withColumn("inner", run - words).join(before, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("b")))
    # Equal rows come apart again, a million at a time.
    many = 1_000_000
    rows = rows.withColumn("_m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / many))))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.col("_m") * many, F.least((F.col("_m") + 1) * many, F.col("copies")) - 1)))
    at = F.col("ahead") + F.col("inner") + F.col("_i") * F.col("size")
    goal = F.round("target").cast("long")
    # Where each copy of this document begins among the source's words, and how much of it the target leaves.
    second = at + F.col("source_size")
    cut = lambda start: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start))
    place = lambda start: F.when(cut(start) > 0, position(F.col("schedule"), start / F.nullif(F.col("target"), F.lit(0.0))))
    out = rows.select("doc_id", "source", "size", "source_size", "target", (cut(at) + cut(second)).alias("taken"), place(at).alias("position"), place(second).alias("second_position"), *carry)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: Everything but the position follows in SQL; the excess is shared again in at most as many rounds as there are sources.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, k, source_size, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
fill AS (
  SELECT 0 AS step, source, k, source_size, weight, false AS shut, (SELECT 1.5 * sum(source_size) FROM w)::DOUBLE AS rest, (SELECT sum(weight) FROM w)::DOUBLE AS open_weight FROM w
  UNION ALL
  SELECT step + 1, source, k, source_size, weight, now_shut,
    ((SELECT 1.5 * sum(source_size) FROM w) - coalesce(sum(CASE WHEN now_shut THEN 2.0 * source_size END) OVER (), 0))::DOUBLE,
    coalesce(sum(CASE WHEN NOT now_shut THEN weight END) OVER (), 0)::DOUBLE
  FROM (SELECT *, shut OR weight * (rest / open_weight) > 2.0 * source_size AS now_shut FROM fill) WHERE step < (SELECT count(*) FROM w)),
t AS (SELECT source, source_size, CASE WHEN shut THEN 2.0 * source_size ELSE weight * (rest / open_weight) END::DOUBLE AS target FROM fill WHERE step = (SELECT max(step) FROM fill)),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  greatest(0, least(size, goal - ahead)) + greatest(0, least(size, goal - ahead - source_size)) AS taken FROM r
"""
