"""The pipeline's stages, each on what the one before it kept."""

import hashlib
import math

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streetloom.llm import bpe, near_dup, pii, quality
from streetloom.llm.common import materialise, table

from . import plain

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, DATA), "test")
        seen[name] = (before, docs)
        if name != "encoding":
            assert docs.columns == columns
    labels = table(spark, DATA, "labels")
    before, after = seen["quality"]
    assert 0 < after.count() < before.count()
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * before.join(labels.where("quality = 1"), "doc_id").count()
    before, after = seen["near_dup"]
    assert 0 < after.count() < before.count() and after.select("text").distinct().count() == after.count()
    before, after = seen["pii"]
    assert before.count() == after.count() and before.where(F.contains("text", F.lit("@"))).count() > 0
    assert after.where(F.rlike("text", F.lit("[a-z0-9]@[a-z0-9]"))).count() == 0
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["mixing"]
    times = after.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] == 2 and times.count() < before.count()
    before, after = seen["encoding"]
    own = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    vocabulary = bpe.load(bpe.word_vocabulary())
    for r in after.limit(20).collect():
        assert r.n_tokens == len(r.ids) == len(vocabulary.encode(own[r.doc_id])[0]) // 4


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    """The whole pipeline on 120 documents against one text, pair and source at a time."""
    docs = table(spark, DATA, "documents").orderBy("doc_id").limit(120)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, DATA, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    folded = quality.fit(docs, table(spark, DATA, "labels", "doc_id", "quality"))
    rows = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    score = {i: sum(float(folded[x]) for x in f) / len(f) + float(folded[-1]) for i, (_, t) in rows.items() for f in [plain.features(t)]}
    left = sorted(i for i in rows if 1 / (1 + math.exp(-score[i])) >= 0.7)
    assert 0 < len(left) < len(rows)
    root = plain.groups([plain.shingles(rows[i][1]) for i in left], 80)
    left = [i for k, i in enumerate(left) if root[k] == k]
    model = pii._fit(spark, pii.PiiParams())
    text = {i: plain.redacted(rows[i][1] or "", sorted([*plain.base_spans(rows[i][1]), *plain.added_spans(rows[i][1], pii.WIDE, pii.CONTEXT, model)])) for i in left}
    size = {i: len(plain.WORD.findall(text[i])) for i in left}
    sources = sorted({rows[i][0] for i in left}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in left if rows[i][0] == s) for s in sources}
    goal = plain.targets([total[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))], 1.5 * sum(total.values()))
    library = Tokenizer.from_file(bpe.word_vocabulary())
    library.no_truncation()
    library.no_padding()
    want = []
    for s, g in zip(sources, goal, strict=True):
        at = 0
        for i in sorted((i for i in left if rows[i][0] == s), key=lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)):
            taken = sum(max(0, min(size[i], round(g) - start)) for start in (at, at + total[s]))
            at += size[i]
            ids = library.encode(text[i], add_special_tokens=False).ids
            want += [(i, ids)] * (int(taken / size[i] + 0.5) if size[i] else 0)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted(want)


def test_near_copies_from_four_fifths_go(spark):
    """104 shingles each: two changed words leave 94 of 114 in common (0.82), three leave 89 of 119 (0.75)."""
    base = [f"w{i}" for i in range(108)]
    two, three = ([("x" + w if i in at else w) for i, w in enumerate(base)] for at in ((30, 70), (20, 50, 80)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, two, three))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.stage_near_dup(spark, docs, DATA).collect()) == [0, 2]
    assert near_dup.near_duplicates(docs).where("kept").count() == 3


def test_rows_with_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("a")), (None, text("a")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (3, ""), (3, None), (4, " "), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    for given in (docs, materialise(docs, "test")):  # rows written first, and rows numbered by their files
        kept = sorted((r.doc_id or 0, (r.text or "").strip()[:1]) for r in corpus_pipeline.stage_near_dup(spark, given, DATA).collect())
        assert kept == [(0, ""), (0, ""), (0, "c"), (0, "d"), (1, "a"), (2, "b"), (3, ""), (4, "")]


def test_mixture_takes_each_row_by_its_own_share(spark):
    """Two sources of 20 equal texts each: 1.5 times all words is 60 texts, of which the first takes 40 and the other 20."""
    rows = [(i if k == "ids" else None if k == "null" else 7, f"{s}{i} b c", s) for k in ("ids", "null", "same") for s in "xy" for i in range(20)]
    for k in range(3):
        docs = spark.createDataFrame(rows[40 * k : 40 * k + 40], "doc_id long, text string, source string")
        got = corpus_pipeline.stage_mixing(spark, docs, DATA).collect()
        assert sorted(sum(r.source == s for r in got) for s in "xy") == [20, 40]


def test_tokens_keep_the_order_of_training(spark):
    """Files of very different sizes, which Spark packs out of their order."""
    docs = spark.createDataFrame([(i, f"{'long words ' * (i % 50) ** 2} {i}", "xyz"[i % 3]) for i in range(400)], "doc_id long, text string, source string").repartition(4)
    mixed = corpus_pipeline.stage_mixing(spark, docs, DATA)
    wanted = [r.doc_id for r in mixed.collect()]
    got = corpus_pipeline.stage_encoding(spark, materialise(mixed, "test"), DATA)
    assert [r.doc_id for r in got.orderBy("part", "row").collect()] == wanted
    loose = corpus_pipeline.stage_encoding(spark, docs.limit(3), DATA).collect()
    assert len(loose) == 3 and all(r.part is None and r.row is None for r in loose)
