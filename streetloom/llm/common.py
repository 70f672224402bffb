"""Shared helpers: paths in the shared folder, written tables, and words."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..tables import materialise, shared_dir, table

__all__ = ["WORD", "ascii_lower", "materialise", "new_path", "table", "word_count"]

#: Bytes that separate words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return path


def ascii_lower(column):
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
