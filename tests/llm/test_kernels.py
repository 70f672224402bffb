"""Kernels without Spark: against brute force, libraries or exact round trips."""

import hashlib
import io
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetloom.llm import bpe, chat, near_dup, quality, shingles, topk, vectors, warc

from . import plain


def test_shingle_sets_have_plain_sizes_and_overlaps():
    r = random.Random(0)
    texts = [" ".join(r.choice(["a", "B", "c", "É", "ß"]) for _ in range(r.randrange(12))) for _ in range(60)] + [None, "", " \t\n", "x" * 200_000, "A b\x0bC", "a b c", "word " * 3000]
    got = list(shingles.shingle_sets(pa.array(texts)))
    sets = [plain.shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(s) for s in sets]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j])


def test_registers_merge_and_estimate():
    p = near_dup.NearDupParams()
    x = shingles.mix(np.arange(1, 3001, dtype=np.uint64))
    a, b = x[:2000], x[200:2200]
    ra, rb, union = near_dup.registers_of([np.sort(a), np.sort(b), np.unique(np.concatenate([a, b]))], p)
    assert (near_dup.merge_registers(ra, rb) == union).all()
    keep, found = near_dup.plausible(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]), p)
    assert abs(found[0] - 1800 / 2200) < 0.15
    far = near_dup.registers_of([np.sort(x[1500:])], p)
    assert not near_dup.plausible(ra[None], far, np.array([2000.0]), np.array([1500.0]), p)[0][0]


PIECES = st.lists(st.sampled_from([*"\\ <>/[]s\n", "<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>", "<<//>>", "<</ROLE>>", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), PIECES)))
def test_formatted_turns_parse_back(turns):
    assert chat.parse("".join(chat.format_turn(r, t) for r, t in turns)) == turns


def test_malformed_chat_is_refused():
    for s in ("x", "<s>[INST] a", "<s>[INST] a[/INST]", " a [/INST]", "<<ROLE>> r <</ROLE>>"):
        assert chat.parse(s) is None


def records(payloads):
    return [warc.build_record(i, f"http://e.org/{i}\r\nX: y", p, hashlib.sha256(p).hexdigest(), None, "2020-01-01T00:00:00Z") for i, p in enumerate(payloads)]


def archive(payloads):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, records(payloads)[:50], warc.WarcParams())
    for r in records(payloads):
        w.add(r)
    return out.getvalue()


@pytest.mark.parametrize("payloads", [[], [b""], [b"x" * 300_000, "é\r\n\r\nWARC/1.1".encode()], [f"<p>{i}</p>".encode() * 20 for i in range(300)]])
def test_archives_read_back(payloads):
    raw = archive(payloads)
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    for chunk in (7, 1 << 16):
        got = [warc.parse_record(r) for r in warc.read_frames(io.BytesIO(raw), chunk=chunk)]
        assert got[0][0]["warc-type"] == "warcinfo"
        assert [warc.payload_of(*g)[2] for g in got[1:]] == payloads


def test_broken_archives_are_refused():
    raw = archive([b"abc" * 100])
    for broken in (raw[:5], raw[:20], raw[:-3]):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(broken)))
    (record,) = records([b"abc"])
    bad = [record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"WARC-Date", b"X-Date"), record[:-1], record + b"x", record.replace(b"Content-Length: ", b"Content-Length: -", 1)]
    for b in bad:
        with pytest.raises(warc.WarcError):
            warc.parse_record(b)
    head, block = warc.parse_record(record)
    with pytest.raises(warc.WarcError):
        warc.payload_of(head, block[:-3] + b"abd")
    with pytest.raises(warc.WarcError):
        warc.payload_of(head, block[:-1])


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(bpe.word_vocabulary()), bpe.load(bpe.word_vocabulary())
    t.no_truncation()
    t.no_padding()
    r = random.Random(2)
    words = list(t.get_vocab())
    texts = ["", "  \n", "ΑΣ ΣΑΣ<|endoftext|>x <|startoftext|>", "aaaaaaaa 'S don't \x1c a\x1db\x85c", "é É İß 한국 日本 👍🏽 ½", "x" * 3000]
    texts += [" ".join("".join(r.choice("abcdefgst") for _ in range(r.randint(1, 25))) for _ in range(50)) for _ in range(100)]
    texts += ["".join(r.choice(words).replace("</w>", r.choice(["", " "])) for _ in range(6)) for _ in range(2000)]
    for x in texts:
        ids, decoded = b.encode(x)
        expected = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, x
        assert decoded.decode() == t.decode(expected, skip_special_tokens=False)


def test_threshold_search_equals_brute_force():
    r = np.random.default_rng(4)
    x = r.integers(-20, 20, (700, 12)).astype(float)
    x[100:130] = x[99]
    block = topk.Block(np.arange(700), x)
    for q in [*x[::70], np.zeros(12), -x[5]]:
        s = x @ q
        s_own = np.delete(s, 3)
        ids = np.delete(np.arange(700), 3)
        order = np.lexsort((ids, -s_own))[:20]
        got_ids, got, _ = topk.search(block, q, 3, 20)
        assert got_ids.tolist() == ids[order].tolist() and got.tolist() == s_own[order].tolist()
        kth = s_own[order][-1]
        again, _, _ = topk.search(block, q, 3, 20, kth)
        assert set(ids[order][s_own[order] > kth]) <= set(again.tolist())


def test_threshold_search_scores_few_rows_of_clustered_vectors():
    """Rows near one of 40 axes each: the bound stops long before all rows are met, at whatever size."""
    r = np.random.default_rng(5)
    shares = []
    for n in (4000, 16_000):
        x = r.integers(-1, 2, (n, 40)).astype(float)
        x[np.arange(n), np.arange(n) % 40] += r.integers(30, 60, n)
        block = topk.Block(np.arange(n), x)
        scored = 0
        for i in range(0, n, n // 40 + 1):
            s = np.delete(x @ x[i], i)
            ids = np.delete(np.arange(n), i)
            order = np.lexsort((ids, -s))[:20]
            got_ids, got, k = topk.search(block, x[i], i, 20)
            assert got_ids.tolist() == ids[order].tolist() and got.tolist() == s[order].tolist()
            scored += k
        shares.append(scored / (40 * n))
    assert shares[0] < 0.15 and shares[1] < 0.05


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200])
def test_int8_bounds_hold_and_links_are_exact(scale):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 16))
    x = np.concatenate([x, x + r.normal(size=x.shape) * 0.06]) * scale
    u = vectors.unit(x)
    q, s, e = vectors.quantise(u)
    guess = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(guess - u @ u.T) <= e[:, None] + e[None] + e[:, None] * e[None] + 1e-12).all()
    hit = vectors.links(x, (q, s, e), x, (q, s, e), 0.98)
    assert (hit == ((u @ u.T) >= 0.98)).all() and 400 < hit.sum() < 2000


@pytest.mark.parametrize("percent,bands", [(85, 24), (80, 36), (100, 24)])
def test_bits_inside_the_join_part_pairs_as_registers_do(percent, bands):
    """Pairs at the threshold pass, pairs 25 points below hardly ever; one bit of each register let through most of them."""
    p = near_dup.NearDupParams(percent=percent, bands=bands)
    r = np.random.default_rng(9)
    planes, words = near_dup.PLANES, -(-p.registers // 64)

    def passed(similarity):
        a = r.integers(0, 60000, (2000, p.registers)).astype(np.uint16)
        b = np.where(r.random(a.shape) < similarity, a, a + r.integers(1, 5000, a.shape).astype(np.uint16)).astype(np.uint16)
        x = (near_dup.bits_of(a) ^ near_dup.bits_of(b)).view(np.uint64).reshape(-1, planes, words)
        n = np.bitwise_count(np.bitwise_or.reduce(x, axis=1)).sum(1)
        assert (n <= (a != b).sum(1)).all()
        return (n <= near_dup.most_differing(p)).mean()

    assert passed(percent / 100) == 1 and passed(percent / 100 - 0.25) < 0.2


def test_bits_of_no_registers():
    """A batch of texts without words has no registers at all."""
    p = near_dup.NearDupParams()
    words = -(-p.registers // 64)
    assert [near_dup.bits_of(np.zeros((n, p.registers), np.uint16)).shape for n in (0, 1, 3)] == [(n, near_dup.PLANES * words) for n in (0, 1, 3)]


def test_dense_tiles_take_little_memory():
    """All pairs of a tile linked: copies of each pair's vectors took 150 MB and more."""
    r = np.random.default_rng(6)
    x = r.normal(size=64) + r.normal(size=(1024, 64)) * 0.01
    q = vectors.quantise(vectors.unit(x))
    tracemalloc.start()
    hit = vectors.links(x, q, x, q, 0.98)
    i, j = np.nonzero(np.triu(hit, 1))
    edges = vectors._forest(i, j, len(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit.all() and len(edges) == 1023 and peak < 40e6


def test_tiles_travel_without_loss():
    for x, size in ((np.float32([[0.1, -3e38]]).astype(float), 4), (np.asarray([[0.1, 1.0]]), 8), (np.asarray([[1e300, 0.0]]), 8)):
        assert len(vectors.packed(x)) == 2 * size and (vectors.unpacked(vectors.packed(x), 1, 2) == x).all()


def test_features_equal_plain_ones():
    r = random.Random(4)
    texts = ["", "a", "aa bb aa aa\tcc", "Ünïcode ß 한국 x", None, " lead", "x" * 300] + ["".join(r.choice("ab é\n.") for _ in range(r.randrange(60))) for _ in range(60)]
    for t, got in zip(texts, quality.features(pa.array(texts), quality.QualityParams()), strict=True):
        assert sorted(got.tolist()) == sorted(plain.features(t))


def test_training_equals_plain_gradient_descent():
    p = quality.QualityParams(bits=6, dim=3, steps=60)
    r = np.random.default_rng(3)
    bags = [(np.unique(r.integers(0, 64, 8)), None) for _ in range(10)]
    bags = [(rows, r.integers(1, 4, len(rows))) for rows, _ in bags]
    labels = np.array([0, 1] * 5)
    rng = np.random.default_rng(p.seed)
    vectors_ = [list(map(float, v)) for v in rng.uniform(-1 / p.dim, 1 / p.dim, (64, p.dim)).astype(np.float32)]
    out, bias, done = [[0.0] * 3, [0.0] * 3], [0.0, 0.0], 0
    while done < p.steps:
        for i in rng.permutation(10)[: p.steps - done].tolist():
            rate, (rows, counts) = p.rate * (1 - done / p.steps), bags[i]
            share = [c / counts.sum() for c in counts]
            hidden = [sum(s * vectors_[x][k] for s, x in zip(share, rows, strict=True)) for k in range(3)]
            e = [np.exp(sum(o * h for o, h in zip(out[c], hidden, strict=True)) + bias[c]) for c in (0, 1)]
            wrong = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            back = [sum(wrong[c] * out[c][k] for c in (0, 1)) for k in range(3)]
            for c in (0, 1):
                out[c] = [o - rate * wrong[c] * h for o, h in zip(out[c], hidden, strict=True)]
                bias[c] -= 0.1 * rate * wrong[c]
            for s, x in zip(share, rows, strict=True):
                vectors_[x] = [v - rate * s * b for v, b in zip(vectors_[x], back, strict=True)]
            done += 1
    want = [sum(v[k] * (out[1][k] - out[0][k]) for k in range(3)) for v in vectors_] + [bias[1] - bias[0]]
    assert quality.train(bags, labels, p) == pytest.approx(np.array(want), abs=2e-3)


def test_automaton_alone_and_in_step_agree():
    """Words on their own against many words in step, among them such as have to go back."""
    b = bpe.load(bpe.word_vocabulary())
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlucm") for _ in range(r.randint(1, 24))).encode() for _ in range(3000)]
    words = [[*w[:-1], w[-1] + 256] for w in words]
    tokens, at = b.automaton.words(np.concatenate([np.array(w, np.int64) for w in words]), np.cumsum([0, *map(len, words)]))
    assert [tokens[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [b.automaton.word(w) for w in words]


def test_bags_come_to_the_driver_packed():
    """Rows and counts unchanged, in less than half of the five bytes a feature that they took."""
    p = quality.QualityParams()
    r = random.Random(3)
    texts = ["", "a", "x" * 300] + [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(400)) for _ in range(20)]
    bags = [np.unique(x, return_counts=True) for x in quality.features(pa.array(texts), p)]
    packed = [quality.packed_bag(*bag) for bag in bags]
    for (rows, counts), bag in zip(bags, packed, strict=True):
        got = quality.unpacked_bag(*bag)
        assert (got[0] == rows).all() and (got[1] == counts).all()
    assert sum(len(a) + len(b) for _, a, b in packed) < 2.5 * sum(len(rows) for rows, _ in bags)


def test_classifier_learns_and_tolerates_one_class():
    p = quality.QualityParams(max_labelled=100, steps=500)
    r = random.Random(0)
    good = [" ".join(r.choice(["the", "cat", "sat", "here"]) for _ in range(30)) for _ in range(40)]
    bad = [" ".join(r.choice(["THE!!", "CAT%%", "###"]) for _ in range(30)) for _ in range(40)]
    bags = [np.unique(f, return_counts=True) for f in quality.features(pa.array(good + bad), p)]
    labels = np.array([1] * 40 + [0] * 40)
    folded = quality.train(bags, labels, p)
    z = [(folded[:-1][b] * n).sum() / n.sum() + folded[-1] for b, n in bags]
    assert all(v > 0 for v in z[:40]) and all(v < 0 for v in z[40:])
    assert not quality.train(bags[:40], labels[:40], p)[:-1].any()
    assert not quality.train([], np.zeros(0, int), p)[:-1].any()
    assert [len(f) for f in quality.features(pa.array(["", None, "a"]), p)] == [1, 1, 2]
