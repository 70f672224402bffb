"""The corpus pipeline: quality, near duplicates, personal data, mixture, tokens; each stage written and read again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.llm import bpe, mixing, near_dup, pii, quality
from streetloom.llm.common import materialise, table


#: The stage links at a similarity of 0.8 (op5_near_dup by itself at 0.85). 36 bands: a pair at 0.8 misses all of them with a
#: probability below 1e-6, as one at 0.85 misses op5's 24.
NEAR = near_dup.NearDupParams(percent=80, bands=36)


#: Texts go to the Python workers in batches of this many bytes, as the stages' workers live beside each other.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """For the pipeline's session: the setting counts when a stage's result is written, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts.

    Each row is judged by its text alone, so repeated rows and ids, null ids and null or empty texts are no special cases:
    a null text counts as empty, which has one feature; an empty table stays empty."""
    _small_batches(spark)
    p = quality.QualityParams()
    folded = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), p)
    scored = quality.score(docs, folded, p, into="_quality")
    return scored.where(F.col("_quality") >= p.accept).select(*docs.columns)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of their own for each row, the same at each reading: ids may repeat or be null.

    Rows read from Parquet files are numbered by file and place in it, without a copy; others are written first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):  # what neither makes rows nor mixes files
        plan = plan.children().head()
    try:
        if plan.nodeName() != "LogicalRelation":
            raise AnalysisException("not read from files")
        at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        files = sorted(r[0] for r in at.select("_file").distinct().collect())
    except AnalysisException:
        return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), name)
    # The broadcast side has a row per file.
    starts = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "_file string, _start long")
    return at.join(F.broadcast(starts), "_file").select(*docs.columns, (F.col("_start") + F.col("_at")).alias("_row"))


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (5-word shingles, similarity 0.8 or more), one with the smallest id.

    Rows are judged each by itself. Of rows that repeat an id and a set one stays; an id with two texts that are not alike
    keeps both; a null id stands after all others, so a copy with one goes, and what is unique stays. Texts without words
    are like nothing: they stay, but of those with one id, null ids apart, only one."""
    _small_batches(spark)
    rows = _numbered(docs, "pipeline-rows")
    found = near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias("_row"), (F.col("n_shingles") == 0).alias("bare"), "component_id")
    named = rows.select("_row", "doc_id", F.xxhash64("text").alias("h")).join(found, "_row").where(~F.col("bare") | F.col("doc_id").isNotNull())
    # Equal ids are parted by their texts, equal rows by their numbers.
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "_row")
    named = materialise(named.select("_row", "bare", F.when(F.col("bare"), F.col("doc_id").cast("long")).otherwise(F.col("component_id")).alias("g"), rank.alias("rank")), "pipeline-groups")
    stay = named.groupBy("bare", "g").agg(F.min("rank").getField("_row").alias("_row"))
    gone = materialise(named.select("_row").join(stay, "_row", "left_anti"), "pipeline-gone")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks; n_chars follows the text.

    Rows stay as many as they are, whatever their ids; a null text stays null and has no characters."""
    return pii.redact_documents(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents by their source's target, in the order of their training positions.

    Documents are taken whole here: as often as the taken words make up the text, rounded. Each row is taken by its own
    share, whether its id repeats or is null."""
    rows = _numbered(docs, "pipeline-rows")
    mixed = mixing.mix(rows.select("doc_id", "source", "text", "_row"), carry=("_row",))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    plan = mixed.withColumn("places", F.slice(F.array("position", "second_position"), F.lit(1), copies.cast("int")))
    plan = materialise(plan.where(F.size("places") > 0).select("_row", "places"), "pipeline-plan")
    placed = rows.join(plan, "_row").withColumn("_place", F.explode("places"))
    return placed.orderBy("_place", "doc_id").select(*docs.columns)


def stage_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its place in training: rows in the order of (part, row) are in mixing's order.

    Spark reads written files packed by size, so the order is taken from the files themselves: the mixing stage's range
    sort numbers them in order, and each is sorted. Both columns are null where docs do not come from Parquet files. Every
    row is encoded by itself, repeated and null ids too; a null text has no tokens."""
    _small_batches(spark)
    name = F.col("_metadata.file_name")
    number = lambda form: F.regexp_extract(name, form, 1).try_cast("long")
    part = number(r"^part-(\d+)") * (1 << 20) + F.coalesce(number(r"-c(\d+)[.]"), F.lit(0))
    try:
        placed = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.row_index").alias("row"))
        placed.schema  # noqa: B018  raises where there are no such files
    except AnalysisException:
        placed = docs.select("doc_id", "text", *(F.lit(None).cast("long").alias(c) for c in ("part", "row")))
    return bpe.encode(placed, bpe.word_vocabulary(), with_ids=True, carry=("part", "row"))


STAGES = [("quality", stage_quality), ("near_dup", stage_near_dup), ("pii", stage_pii), ("mixing", stage_mixing), ("encoding", stage_encoding)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
