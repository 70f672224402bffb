"""Quality classifier: supervised subword embeddings.

Every word, every pair of neighbouring words and every character n-gram (3 to 5 characters, word ends included) is
hashed into a table of learned vectors. Pairs are hashed without order, by the exclusive or of their words' hashes; so a
word beside itself gives one and the same feature, whatever the word. A document is the average of its features' vectors, and a softmax over two classes reads it. Training is
stochastic gradient descent in numpy, on the driver, over a bounded sample of labelled documents (`max_labelled`, drawn by
a hash of doc_id); scoring covers every document.

For two classes softmax needs only the difference of the classes' weights, so the output layer folds into the table after
training: a document's score is the logistic of the average of one number per feature. The folded table has 2**bits
numbers whatever the corpus, which is what executors receive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .shingles import _SPACE, mix, slices, utf8, word_bounds, word_hashes


@dataclass(frozen=True)
class QualityParams:
    bits: int = 17
    dim: int = 12
    ngrams: tuple[int, ...] = (3, 4, 5)
    #: Training takes at most this many labelled rows, and of these, in their order, as many as have this many bytes in
    #: all; texts are taken whole or not at all.
    max_labelled: int = 3000
    max_bytes: int = 4 << 20
    #: Steps of gradient descent, one document each, however many are labelled.
    steps: int = 36_000
    rate: float = 2.0
    seed: int = 7
    accept: float = 0.7


def _code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), first[at]


def features(column, p: QualityParams) -> Iterator[np.ndarray]:
    """For each text the table rows of its features, with repeats: the document itself, its words, its pairs of words and
    its n-grams."""
    raw, at = utf8(column)
    starts, ends, first = word_bounds(raw, at)
    words = word_hashes(raw, starts, ends, lower=False)
    pairs = np.zeros(len(words), np.int32)
    pairs[1:] = (mix(words[1:] ^ words[:-1]) >> np.uint64(64 - p.bits)).astype(np.int32)
    words = (words >> np.uint64(64 - p.bits)).astype(np.int32)
    cp, at = _code_points(raw, at)
    space = (cp < 256) & _SPACE[np.minimum(cp, 255)]
    c = np.where(space, np.uint32(0x20), cp)
    grams = []
    inner = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(space, out=inner[1:])
    for n in p.ngrams:
        m = max(0, len(cp) - n + 1)
        h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h ^= c[k : k + m]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        rows = (h >> np.uint32(32 - p.bits)).astype(np.int32)
        # White space may stand at either end only; a gram that leaves its document is cut off below.
        whole = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m] if n > 2 else np.ones(m, bool)
        grams.append((n, rows, whole))
    one = np.zeros(1, np.int32)
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        parts = [one, words[first[i] : first[i + 1]], pairs[first[i] + 1 : first[i + 1]]]
        for n, rows, whole in grams:
            if b - a >= n:
                parts.append(rows[a : b - n + 1][whole[a : b - n + 1]])
        yield np.concatenate(parts)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: QualityParams) -> np.ndarray:
    """Fit vectors and softmax; return the folded table, whose last number is the bias.

    bags: distinct table rows and their counts, one per document. Without labels of both classes the table is zero and
    the bias is the smoothed log-odds of the labels, so all documents score alike."""
    good = int((labels == 1).sum())
    prior = np.log((good + 1) / (len(labels) - good + 1))
    folded = np.zeros((1 << p.bits) + 1, np.float32)
    folded[-1] = prior
    if good in (0, len(labels)):
        return folded
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bits, p.dim)).astype(np.float32)
    out, bias = np.zeros((2, p.dim), np.float32), np.asarray([-prior / 2, prior / 2], np.float32)
    done = 0
    shares = [(counts / counts.sum()).astype(np.float32) for _, counts in bags]
    while done < p.steps:
        for i in rng.permutation(len(bags))[: p.steps - done]:
            rate = np.float32(p.rate * (1 - done / p.steps))
            rows, share = bags[i][0], shares[i]
            hidden = share @ vectors[rows]
            z = out @ hidden + bias
            e = np.exp(z - z.max())
            wrong = e / e.sum()
            wrong[int(labels[i])] -= 1
            back = wrong @ out
            out -= rate * np.outer(wrong, hidden)
            bias -= np.float32(0.1) * rate * wrong
            vectors[rows] -= rate * share[:, None] * back
            done += 1
    folded[:-1] = vectors @ (out[1] - out[0])
    folded[-1] = bias[1] - bias[0]
    return folded


def held_out(doc_id):
    """True for the fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest one needs: 1, 2 or 4."""
    most = int(counts.max())
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def packed_bag(rows: np.ndarray, counts: np.ndarray) -> tuple[int, bytes, bytes]:
    """The number of distinct rows (in order), the steps between them and their counts, compressed: what the driver's JVM
    holds of a sample is a fraction of the numbers'."""
    return len(rows), zlib.compress(_packed(np.diff(rows, prepend=0)), 1), zlib.compress(_packed(counts), 1)


def unpacked_bag(n: int, steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = (np.frombuffer(raw, f"<u{len(raw) // n}") for raw in map(zlib.decompress, (steps, counts)))
    return np.cumsum(steps, dtype=np.int32), counts


def sample(documents: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """doc_id, quality, text of the labelled rows to learn from: one row per id, in the order of a hash, within the limits."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # Narrow rows first: an id that occurs often counts as one row, its smallest text by hash.
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), size.alias("size")).join(known, "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "size")).alias("t")).select("doc_id", "quality", "t.h", "t.size")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    # At most max_labelled rows meet in this window.
    upto = F.sum("size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.withColumn("upto", upto).where(F.col("upto") <= p.max_bytes).select("doc_id", "quality", "h")
    # The broadcast side has at most max_labelled rows of three numbers.
    texts = documents.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"])
    return texts.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").dropDuplicates(["doc_id"])


def fit(documents: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> np.ndarray:
    """Learn from a bounded sample of the labelled documents outside the held-out fold."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                bags = [packed_bag(*np.unique(x, return_counts=True)) for x in features(batch.column("text"), p)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("quality"), *(pa.array([bag[i] for bag in bags], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))],
                    names=["doc_id", "quality", "n", "steps", "counts"],
                )

    got = sorted(sample(documents, labels, p).mapInArrow(kernel, "doc_id long, quality int, n int, steps binary, counts binary").collect())
    # What comes to the driver: a byte or two for each distinct feature of a text.
    labels_ = [r.quality for r in got]
    bags = [unpacked_bag(r.n, r.steps, r.counts) for r in got]
    del got
    return train(bags, np.asarray(labels_, np.int64), p)


def score(documents: DataFrame, folded: np.ndarray, p: QualityParams = QualityParams(), into: str = "score") -> DataFrame:
    """All columns of documents and the score of `text`; a column that is already called like it is replaced."""
    documents = documents.drop(into)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, bias = folded[:-1], float(folded[-1])
        for whole in batches:
            for batch in slices(whole, "text", limit=1 << 20):
                z = np.fromiter((values[x].mean(dtype=np.float64) + bias for x in features(batch.column("text"), p)), np.float64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names, into])

    return documents.mapInArrow(kernel, T.StructType([*documents.schema.fields, T.StructField(into, T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """documents (doc_id, text) and labels (doc_id, quality 0 or 1) -> doc_id, held_out, score, predicted.

    Defined cases: a null text counts as empty, an empty text has the document feature alone; labels other than 0 and 1,
    null ids and labels of unknown documents teach nothing, of several labels for one id the larger counts; a null
    doc_id is scored and not held out; repeated rows score alike; without labels of both classes all documents get the
    same score; an empty table gives no rows; other columns are ignored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folded = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), p)
    scored = score(docs, folded, p).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.accept).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
