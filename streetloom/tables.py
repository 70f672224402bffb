"""Tables written in the shared folder to cut lineage, and readers of the driver's tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="streetloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/streetloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; the folder goes when the application ends.

    Loops use this between rounds: plans stay short, a lost executor costs a re-read, and both sides of a following join
    are plain exchanges, which adaptive execution can split when one key is hot."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def materialise_counting(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """materialise(df), and the number of its rows that fulfil the condition, counted while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(condition).alias("n")), name)
    return out, seen.get["n"]


_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def free(*tables: DataFrame | None) -> None:
    """Delete what materialise wrote for these very DataFrames; nothing that was derived from them may be read after it."""
    for df in tables:
        if df is not None and (path := _WRITTEN.pop(df, None)):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def replace(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """materialise(new), after which the table of the round before is deleted."""
    out = materialise(new, name)
    free(old)
    return out


def unbroadcast(df: DataFrame) -> DataFrame:
    """df as the side of a join that exchanges both sides, for rows that explode has made: Spark takes their size from the
    file they come from, however many they are, and would send them all through the driver."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
