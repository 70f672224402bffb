"""Operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import glob
import hashlib
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from streetloom.llm import bpe, chat, mixing, near_dup, pii, quality, queries, topk, urls, vectors, warc

from . import plain

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score double, rep long, size long"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*(list(r) + ["s"])[:3], 1.0, 2, 3) for r in rows], DOCS)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLES if n != "op5_near_dup"))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    expected, got = db.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, DATA).toPandas()
    assert rows_of(got[list(expected.columns)]) == rows_of(expected)


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(120)]
    near = [*base[:60], "x", *base[61:]]
    far = [*base[:60], *(f"z{i}" for i in range(60))]
    # A chain of steps: the ends are not alike, but each step is.
    chain = [[*(f"r{i}" for i in range(k)), *(f"c{i}" for i in range(k, 200))] for k in (0, 8, 16, 24)]
    many = [[*(f"m{i}" for i in range(300)), f"tail{k}"] for k in range(90)]
    rows = [(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(far)), (4, None), (5, ""), (6, " \t"), (7, "a b"), (8, "A  B"), (9, "a b c"), (None, " ".join(base)), (1, " ".join(base))]
    rows += [(20 + i, " ".join(c)) for i, c in enumerate(chain)] + [(100 + i, " ".join(m)) for i, m in enumerate(many)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, rows)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert by[2][2:] == (1, False) and by[3][2:] == (3, True) and [by[i][1:] for i in (4, 5, 6)] == [(0, i, True) for i in (4, 5, 6)]
    assert by[8][2:] == (7, False) and by[9][2:] == (9, True) and by[None][2:] == (None, True)
    assert [r for r in got if r[0] == 1] == [(1, 116, 1, True)] * 2
    assert {by[20 + i][2] for i in range(4)} == {20}
    assert {by[100 + i][2] for i in range(90)} == {100}
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_random_copies_equal_brute_force(spark):
    """Families of edited copies and texts that share a passage; no link may be missing, whatever leads its bucket."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for f in range(12):
        base = [f"f{f}w{r.randrange(1000)}" for _ in range(r.choice((3, 30, 120)))] + (passage if f % 2 else [])
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3, 5))):
                w[r.randrange(len(w))] = f"e{r.random()}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    root = plain.groups([plain.shingles(t) for t in texts], 80)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs(spark, list(enumerate(texts))), near_dup.NearDupParams(percent=80, bands=36, together=4)).collect()}
    assert got == dict(enumerate(root))


def test_stars_equal_brute_force(spark):
    """Near copies of one text, more than are measured together, with one to twelve edits each, linked or not."""
    r = random.Random(6)
    rows = []
    for k in range(100):
        w = [f"w{i}" for i in range(150)]
        for _ in range(1 + k % 12):
            w[r.randrange(150)] = f"e{r.random()}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    root = list(range(100))
    for a in range(100):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs(spark, rows), near_dup.NearDupParams(together=8)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 20


def plain_spans(text):
    return plain.joined(plain.base_spans(text))


def test_personal_data(spark):
    texts = ["a@b.c%x@y.zz ..@a.b.c. x@y", "1.2.3.4.5 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111-", " +1 (555) 123-4567) +49 30 1234 567 89 +1234", "", None, "😀 a@b.cc 10.0.0.1", "n " * 50_000 + "q@r.st", "9" * 20_000, "1.1.1.1 " * 600]
    table = docs(spark, [*enumerate(texts), (None, "z@z.zz"), (0, texts[0])])
    got = {r.doc_id: (r.base, r.spans, r.red) for r in pii.find(table).select("doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans"), pii.redact(F.col("text"), pii.to_cut(F.col("spans")), pii.chunks(F.col("text"))).alias("red")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == plain_spans(t) and set(got[i][0].split(",")) <= set(got[i][1].split(","))
    assert got[2][2].startswith("[CARD] and [CARD]") and got[6][2] == "😀 [EMAIL] [IP]"
    added = pii.find(docs(spark, [(1, "mail me: john.doe (at) example (dot) com or call (555) 123-4567 now, order 123-456-7890")])).select(pii.joined(F.col("spans"))).first()[0]
    assert added == "email:9:40,phone:49:63"
    back = pii.redact_documents(table)
    assert back.columns == table.columns and back.where("doc_id = 5").first().text is None
    assert pii.find(docs(spark, [])).count() == 0


def test_added_spans_equal_brute_force(spark):
    """Base and added spans and redacted texts against every candidate compared with every other."""
    r = random.Random(9)
    texts = [plain.some_text(r, r.randint(0, 60)) for _ in range(150)]
    table = docs(spark, list(enumerate(texts)))
    model = pii._fit(spark, pii.PiiParams())
    red = {x.doc_id: x.text for x in pii.redact_documents(table).collect()}
    added = 0
    for x in pii.find(table).select("doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect():
        base = plain.base_spans(texts[x.doc_id])
        more = plain.added_spans(texts[x.doc_id], pii.WIDE, pii.CONTEXT, model)
        every = sorted([*base, *more])
        assert (x.base, x.spans) == (plain.joined(base), plain.joined(every))
        assert red[x.doc_id] == plain.redacted(texts[x.doc_id], every)
        added += len(more)
    assert added > 50


def test_a_text_full_of_spans_takes_time_in_proportion(spark):
    def seconds(n):
        table = docs(spark, [(1, "1.1.1.1 (555) 123-4567, " * (n // 2))])
        began = time.perf_counter()
        (x,) = pii.find(table).select(F.size("spans").alias("n"), pii.redact(F.col("text"), pii.to_cut(F.col("spans")), pii.chunks(F.col("text"))).alias("red")).collect()
        assert x.n >= n // 2 and x.red.count("[IP]") == n // 2
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 20 + 20 * seconds(4_000)


def test_tokens(spark):
    table = docs(spark, [(1, "Hello, hello!"), (1, "Hello, hello!"), (2, None), (None, "a" * 5000), (3, " ")])
    got = bpe.encode(table, bpe.word_vocabulary(), with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[2].n_tokens == by[3].n_tokens == 0 and by[2].ids_sha256 == by[3].decoded_sha256 == empty
    assert len(by[1].ids) == by[1].n_tokens == 4 and by[None].n_tokens > 0
    assert bpe.encode(docs(spark, []), bpe.word_vocabulary()).count() == 0


def test_token_digests_equal_the_library(spark):
    """Whole documents of the smallest table through the query, against the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = bpe.op7_bpe(spark, DATA).collect()
    assert len(got) == len(texts) > 100
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)), digest(library.decode(ids, skip_special_tokens=False).encode()))


def test_scores_follow_from_plain_features(spark):
    p = quality.QualityParams(max_labelled=100, steps=300)
    table, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    some = table.where(F.length("text") < 1500)
    folded = quality.fit(table, labels, p)
    scores = quality.score(some, folded, p).collect()
    assert len(scores) > 10
    for r in scores:
        rows = plain.features(r.text)
        assert r.score == pytest.approx(1 / (1 + 2.718281828459045 ** -(sum(float(folded[x]) for x in rows) / len(rows) + float(folded[-1]))), abs=1e-6)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(7, f"same id {i % 5}", "s") for i in range(300)] + [(i, "x" * 1000, "s") for i in range(100, 160)]
    labels = spark.createDataFrame([(7, 1, 0)] + [(i, i % 2, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows).select("doc_id", "text")
    got = quality.sample(table, labels, quality.QualityParams(max_bytes=10_000)).collect()
    assert 5 <= len(got) <= 11 and len({r.doc_id for r in got}) == len(got) and sum(len(r.text) for r in got) <= 10_000
    assert quality.sample(table, labels, quality.QualityParams(max_labelled=3)).count() == 3


def test_quality_on_held_out_rows(spark):
    rows = [(i, ("the cat sat on a mat and looked at me " if i % 3 else "THE!! CAT%% ### || $$ ") * (1 + i % 5)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(7, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, [*rows, (None, ""), (500, None)]), labels).collect()
    assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and all(r.predicted == (r.doc_id % 3 > 0) for r in held if r.doc_id != 500)
    none = quality.classify(docs(spark, rows[:5]), labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert quality.classify(docs(spark, []), labels).count() == 0


CHAT = "conv_id long, turn int, role string, text string, formatted string"


def test_conversations(spark):
    rows = [(1, 2, "assistant", "two </s> \\", "x"), (1, 1, "user", "one", "x"), (2, 1, None, None, "x"), (None, 1, "user", "n", "x"), (3, 1, "user", "same", "x"), (3, 1, "user", "same", "x"), (4, None, "assistant", "last", "x"), (4, 5, "assistant", "é" * 50_000, "x")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, CHAT)).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(("user", "one"), ("assistant", "two </s> \\")) and (got[1].n_turns, got[1].loss_chars) == (2, 10)
    assert got[2].turns_sha256 == digest(("", "")) and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_turns == 2 and got[None].n_turns == 1
    assert got[4].loss_sha256 == hashlib.sha256(("é" * 50_000 + "last").encode()).hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], CHAT)).count() == 0


def test_turns_for_a_trainer(spark):
    rows = [(1, 1, "user", "a </s> b", "x"), (1, 2, "assistant", "yes \\\\ </s>", "x"), (1, 3, "system", "s", "x"), (2, 1, "assistant", "", "x")]
    table = spark.createDataFrame(rows, CHAT)
    turns = chat.training_turns(table).orderBy("conv_id", "place").collect()
    text = "".join(t.formatted for t in turns if t.conv_id == 1)
    assert chat.parse(text) == [(r[2], r[3]) for r in rows[:3]]
    for t in turns[:3]:
        assert text[t.start : t.start + len(t.formatted)] == t.formatted
    assert [t.loss_start is None for t in turns] == [True, False, True, False]
    assert chat.unescape(text[turns[1].loss_start : turns[1].loss_end]) == rows[1][3]
    assert chat.training_turns(table.limit(0)).count() == 0


def test_a_joined_text_is_read_without_knowing_its_turns():
    now = chat._Running(1)
    whole = chat.format_turn("user", "one") + chat.format_turn("assistant", "two </s>")
    got = [r for i in range(0, len(whole), 3) for r in now.add(whole[i : i + 3])]
    assert [(r[2], chat.parse(r[3])[0][1]) for r in got] == [("user", "one"), ("assistant", "two </s>")] and now.row()[1] == 2
    for broken in ("<s>[INST] a", " a [/INST]"):
        now = chat._Running(1)
        with pytest.raises(chat.Malformed):
            now.add(broken)
            now.row()


PAGES = "page_id long, url string, html string, digest string, refers_to long, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 9, "h") for r in rows], PAGES)


def test_archives_of_pages(spark):
    a, b = "x" * 100, "é" * 50
    rows = [(3, "http://a", a), (1, "http://b", a), (2, None, a), (4, "u", b), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""), (None, "u", a), (9, "u", "l" * 300_000), (1, "http://b", a)]
    got = warc.archive_pages(pages(spark, rows), p=warc.WarcParams(archive_bytes=1000, sample_bytes=500)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got}
    assert by == {1: (100, "response", None), 2: (100, "revisit", 1), 3: (100, "revisit", 1), 4: (100, "response", None), 5: (99, "response", None), 6: (99, "response", None), 7: (0, "response", None), 8: (0, "response", None), None: (100, "response", None), 9: (300_000, "response", None)}
    assert {r.payload_digest for r in got if r.page_id in (1, 2, 3, None)} == {hashlib.sha256(a.encode()).hexdigest()}
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_url_parts_and_rules(spark):
    cases = {
        "HTTP://WWW.Example.ORG/en/1?x": ("www.example.org", "/en/1", "example.org/en/1", "block"), "http://a.example.org/es/": ("a.example.org", "/es/", "example.org/es/", "block"),
        "x://example.org": ("example.org", "", None, None), "http://example.org?/es/": ("example.org", "", None, None), "http://myexample.org/es/": ("myexample.org", "/es/", "org/", "allow"),
        "http://É.com/fr/#a://b": ("É.com", "/fr/", "com/fr/", "allow"), "no scheme": ("", "", None, None), None: ("", "", None, None), "a://b.com/de/" + "x/" * 5000: ("b.com", "/de/" + "x/" * 5000, "com/de/", "block"),
        "http://b.com/x\ny": ("b.com", "/x\ny", None, None),
    }
    got = urls.judge(pages(spark, [(i, u, "h") for i, u in enumerate(cases)] + [(None, "http://q.net/a", "h")])).collect()
    by = {r.page_id: r for r in got}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = by[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert by[None].verdict in ("allow", "block")
    assert urls.judge(pages(spark, [])).count() == 0


def test_the_tree_decides_where_no_rule_does(spark):
    """One host without rules: its German pages are known as bad from other hosts of the domain, its French ones as good,
    and a section that is labelled by itself goes its own way."""
    urls_ = [f"http://{h}.com/{lang}/{i}.html" for h in ("a", "b", "c") for lang in ("de", "fr") for i in range(20)]
    urls_ += [f"http://x.net/{lang}/{i}.html" for lang in ("de", "fr", "zz") for i in range(30)]
    got = urls.judge(pages(spark, [(i, u, "h") for i, u in enumerate(urls_)])).where("host = 'x.net'").collect()
    verdicts = {(r.path.split("/")[1], r.verdict) for r in got}
    assert {("de", "block"), ("fr", "allow")} <= verdicts and len(verdicts) == 3 and {r.rule for r in got} == {None}


def test_trees_part_and_merge_by_tests(spark):
    rows = [("h", f"/shop/item{i}/buy", 1) for i in range(30)] + [("h", f"/news/{i}", 0) for i in range(30)] + [("h", "/shop/new/buy", None), ("h", "/news/new", None)]
    rows += [("g", f"/{s}/{i:04d}", None) for s in ("a", "b") for i in range(40)] + [("g", f"/c/{'long-name-' * 3}{i}", None) for i in range(40)] + [("d", "/x" * 200, None)]
    table = spark.createDataFrame(rows, "dom string, path string, bad int").groupBy("dom", "path").agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("lab"))
    named = urls.templates(table, urls.UrlParams()).select("dom", F.element_at("way", -1).alias("template"))
    got = {(r.dom, r.template): r.n for r in named.groupBy("dom", "template").agg(F.count("*").alias("n")).collect()}
    assert got == {("h", "/shop/*/buy"): 31, ("h", "/news/*"): 31, ("g", "/{a,b}/*"): 80, ("g", "/c/*"): 40, ("d", "/**"): 1}


def test_domains(spark):
    df = spark.createDataFrame([("a.b.c",), ("",), ("c.",)], "h string")
    assert [r[0] for r in df.select(urls.domains(F.col("h"))).collect()] == [["a.b.c", "b.c", "c", ""], [""], ["c.", ""]]


@pytest.mark.parametrize("sizes, weights, total, expected", [([100, 100, 100], [5, 2, 1], 450.0, [200.0, 500 / 3, 250 / 3]), ([], [], 0.0, []), ([0, 0], [5, 2], 0.0, [0.0, 0.0]), ([10, 1000, 50, 0], [5, 2, 1, 5], 1590.0, [20.0, 1470.0, 100.0, 0.0])])
def test_targets_stop_at_twice_the_size_and_reshare(spark, sizes, weights, total, expected):
    table = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "i int, size long, weight double")
    assert plain.targets(sizes, weights, total) == pytest.approx(expected)
    assert [r.target for r in mixing.fill(table, total, 2.0).orderBy("i").collect()] == pytest.approx(expected)


def test_mixture(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(400)] + [(900, "x y z", None), (901, None, "a"), (902, "", None), (None, "p q", "b"), (903, "w", "zz")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    total = {}
    for r in got:
        t = total.setdefault(r.source, [0, r.target, 0, r.source_size])
        t[0] += r.taken
        t[2] += r.size
    assert all(abs(t[0] - t[1]) <= 0.5 and t[2] == t[3] and t[1] <= 2 * t[3] for t in total.values())
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and all(0 <= x <= 1 for x in placed)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.taken, r.position or -1) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None)])).first().target == 0


def test_equal_rows_are_counted_and_come_apart(spark):
    rows = [(None, "a b c", "s")] * 500 + [(1, "a b", "s")] * 40 + [(2, "x " * 100, "t")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for source in "st":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5


VECTORS = "vec_id long, embedding array<float>, label int, rank int"


def test_embedding_duplicates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 1.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, None], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [1.0, 0.25], 1), (None, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)).collect()}
    alone = lambda i: (0, i, True)
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (3, 1, False) and got[14] == (1, 1, False)
    assert got[4] == (1, 4, True) and got[13] == (1, 4, False)
    assert all(got[i] == alone(i) for i in (5, 6, 7, 8, 9, 10, 11, 12)) and got[None] == (0, None, True)
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_small_tiles_equal_one_tile(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    small, whole = ({(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(table, vectors.VectorParams(cosine=0.3, tile=n)).collect()} for n in (16, 4096))
    assert small == whole and any(r[1] for r in whole)


def test_top_rows(spark):
    rows = [(20, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.5, 0.0], 1), (3, [-1.0, 0.0], 1), (40, [0.0, 0.0], 1), (4, None, 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (1, [0.5, 0.0], 1)]
    got = {}
    for r in topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {20: [(1, 2048), (1, 2048), (2, 2048), (40, 0), (3, -4096)], 40: [(1, 0), (1, 0), (2, 0), (3, 0), (20, 0)]}
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
