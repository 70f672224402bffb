"""PII by candidate gradient boosting, in DataFrame functions only.

Base spans come from four fixed patterns and their checks. Besides, wider generators propose overlapping candidates
(spelled-out mail addresses, IPv6, national telephone numbers, card numbers with other separators). Boosted regression
trees read format and context features of each candidate; their sum is calibrated to a probability, and candidates at or
above the threshold of their kind are added. Among overlapping added spans the likeliest stays, and none may overlap a
base span. The trees are learned on the driver from a fixed phrase book of labelled examples, whose features come from the
same expressions as those of the corpus, and are compiled to CASE expressions; texts never leave the JVM.
"""

from __future__ import annotations

import functools
import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Repeats are possessive and runs are entered at their first character only (or where
#: the last match ended), which finds the same matches in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wider generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20|\x20AT\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20|\x20DOT\x20)\x20?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9](?:[\x20./-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[\x20./-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}+(?![0-9A-Za-z.-])",
}
#: What may stand before a span, by the kind that it speaks for; the last speaks against all.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|schreib|courriel|correo)",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|login|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|paid|pay)",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|anruf|appel|llama)",
    "not": r"(?i)\b(?:order|invoice|isbn|version|ref|serial|sku|key|token|total|page|date|score|part|at the)",
}
_BEFORE = 24
_BLOCK = 256
_CHUNK = 4096
#: A candidate has 164 characters at most, and in as many characters begin no more than 76 candidates, as those of a kind
#: don't overlap and have 6 (email), 15 (ip), 13 (card) and 8 (phone) at least. So what overlaps a candidate is that near.
_NEAR = 80


@dataclass(frozen=True)
class PiiParams:
    trees: int = 24
    depth: int = 3
    rate: float = 0.3
    examples: int = 2400
    seed: int = 5
    precision: float = 0.98


@dataclass
class Model:
    """Trees as nested (feature, cut, low, high) or leaf numbers, the calibration line and the threshold of each kind."""

    trees: list
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def _long(x: Column) -> Column:
    return F.length(x).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def blocks(values: Column) -> Column:
    """An array in pieces of _BLOCK; the array must not be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def most_before(values: Column) -> Column:
    """For each number of an array the greatest one ahead of it, and 0 for the first; by blocks, so that arrays stay short."""
    start = lambda m: F.struct(m.alias("m"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct(F.greatest(acc["m"], x).alias("m"), F.concat(acc["out"], F.array(acc["m"])).alias("out"))
    zero = F.lit(0).cast("long")
    inner = lambda parts: F.flatten(F.zip_with(parts, F.aggregate(F.transform(parts, F.array_max), start(zero), step, lambda acc: acc["out"]), lambda part, m: F.aggregate(part, start(m), step, lambda acc: acc["out"])))
    return F.when(F.size(values) > 0, let(blocks(values), inner)).otherwise(F.array().cast("array<bigint>"))


_MATCH = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str, need: Column, context: bool = False) -> Column:
    """array<struct<start, end, m, before, after>>: the non-overlapping matches of a pattern in code points.

    What lies between the matches gives their places, summed up in blocks so that very many matches stay cheap. before and
    after, if asked for, are the characters beside a match, as far back as the match ahead of it begins; they come from
    what lies between too, so no text is walked again for each match. `need` is a cheap condition that holds for every text
    with a match."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_MATCH).alias("out"))
    span = lambda x, a: F.struct(a.alias("start"), (a + x["n"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

    def step(acc, x):
        a = acc["at"] + x["g"]
        return F.struct((a + x["n"]).alias("at"), F.concat(acc["out"], F.array(span(x, a))).alias("out"))

    def join(acc, b):
        moved = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def places(found):
        def steps(gaps):
            none = F.lit("")
            before = lambda i: F.right(F.concat(F.coalesce(F.get(found, i - 1), none), gaps[i]), F.lit(_BEFORE))
            after = lambda i: F.substring(F.concat(gaps[i + 1], F.coalesce(F.get(found, i + 1), none)), 1, 1)
            return F.transform(found, lambda m, i: F.struct(_long(gaps[i]).alias("g"), _long(m).alias("n"), m.alias("m"), (before(i) if context else none).alias("before"), (after(i) if context else none).alias("after")))

        all_ = lambda x: F.aggregate(F.transform(blocks(x), lambda part: F.aggregate(part, zero, step)), zero, join, lambda acc: acc["out"])
        return let(F.split(text, pattern, -1), lambda gaps: let(steps(gaps), all_))

    return F.when(need & F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), 0), places)).otherwise(F.array().cast(_MATCH))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check digit rule."""

    def add(acc, i):
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).try_cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return (F.length(d) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0)


def small_parts(m: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(m, r"\.", -1), lambda p: (F.length(bare(p)) <= 3) & (bare(p).try_cast("int") <= 255))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": small_parts,
    "card": lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


def _needs(text: Column) -> dict[str, Column]:
    """What every text with a base span of a kind holds, and by wide_ the same for the generators."""
    digit = F.rlike(text, F.lit("[0-9]"))
    has = lambda s: F.contains(text, F.lit(s))
    return {"email": has("@"), "ip": digit & has("."), "card": digit, "phone": has("+"), "wide_email": F.rlike(text, F.lit(r"@|[(\[ ](?:at|AT)[)\] ]")), "wide_ip": has(":"), "wide_card": digit, "wide_phone": digit}


def base_of(text: Column, kind: str) -> Column:
    """The base spans of a kind, in order."""
    found = F.filter(matches(text, BASE[kind], _needs(text)[kind]), lambda x: CHECKS[kind](x["m"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["m"].alias("m")))


def candidates(text: Column) -> Column:
    """What the wider generators propose, sorted by start and kind; candidates of different kinds may overlap."""
    need = _needs(text)
    tagged = lambda k: F.transform(matches(text, WIDE[k], need[f"wide_{k}"], context=True), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
    return F.array_sort(F.concat(*(tagged(k) for k in KINDS)))


FEATURES = ("kind", "n_chars", "n_digits", "n_groups", "luhn", "first_zero", "paren", "dots", "dashes", "spaces", "letters", "before_word", "after_word", *(f"says_{k}" for k in CONTEXT))


def feature_values(c: Column) -> list[Column]:
    """The features of a candidate, in the order of FEATURES, as doubles."""
    m, d, before = c["m"], digits(c["m"]), c["before"]
    count = lambda s: F.length(m) - F.length(F.replace(m, F.lit(s), F.lit("")))
    values = [
        c["kind"], F.length(m), F.length(d), F.size(F.split(m, "[^0-9A-Za-z]+", -1)), luhn(d), F.startswith(d, F.lit("0")), F.contains(m, F.lit("(")), count("."), count("-"), count(" "),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.rlike(before, F.lit(r"[\p{L}0-9]$")), F.rlike(c["after"], F.lit(r"[\p{L}0-9]")), *(F.rlike(before, F.lit(p)) for p in CONTEXT.values()),
    ]
    return [v.cast("double") for v in values]


def phrase_book(p: PiiParams) -> list[tuple[str, int, int, int]]:
    """Labelled examples (text, start, end, 1 for personal): spans in typical sentences, and look-alikes."""
    r = random.Random(p.seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("aeiourstnlmdp") for _ in range(r.randint(3, 9)))

    def card(sep: str) -> str:
        x = r.choice("3456") + d(14)
        total = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 == 0 else int(c) for i, c in enumerate(x))
        x += str(-total % 10)
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    yes = [
        (("mail", "write to", "contact", "e-mail:"), lambda: f"{w()}.{w()}{r.choice((' (at) ', ' [at] ', '(at)', ' at '))}{w()}{r.choice((' (dot) ', ' [dot] ', '(dot)', ' dot '))}{r.choice(('com', 'org', 'net', 'de'))}"),
        (("host", "login from", "ip", "server"), lambda: ":".join(f"{r.randint(0x1000, 0xFFFF):x}" for _ in range(8))),
        (("card", "paid by visa", "credit card"), lambda: card(r.choice((".", "/")))),
        (("phone", "call", "tel.", "fax", "mobile:"), lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(200, 999)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(2)}.{d(3)}.{d(4)}"))),
    ]
    no = [
        (("order", "invoice", "total", "ref", "part"), lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        (("isbn", "serial", "sku", "key"), lambda: f"{d(3)}-{d(1)}{d(2)}-{d(4)}-{d(3)}"),
        (("version", "page", "score", "date"), lambda: r.choice((f"{d(2)}.{d(2)}.{d(4)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)} {d(3)} {d(3)}"))),
        (("order", "token", "serial", "and", "the"), lambda: d(r.randint(13, 19))),
        (("and", "of", "the", "that"), lambda: r.choice((f"{d(2)} {d(3)} {d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(2)} {d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}"))),
        (("look", "we met", "stay", "arrive"), lambda: f"{w()} at {w()} dot {w()}"),
    ]
    out = []
    for i in range(p.examples):
        words, make = r.choice(yes if i % 2 else no)
        head = f"{' '.join(w() for _ in range(r.randint(0, 6)))} {r.choice(words)} ".lstrip()
        span = make()
        out.append((f"{head}{span}{r.choice((' ', '. ', ', '))}{w()} {w()}", len(head), len(head) + len(span), i % 2))
    return out


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float):
    """A regression tree on gradients, by exact search over at most 32 cuts of each feature."""
    leaf = float(-rate * grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best = (1e-3, -1, 0.0)
    whole = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 32))) if len(values) > 1 else ():
            low = x[:, f] < cut
            g, h = grad[low].sum(), hess[low].sum()
            gain = g * g / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] < best[2]
    return best[1], best[2], _grow(x[low], grad[low], hess[low], depth - 1, rate), _grow(x[~low], grad[~low], hess[~low], depth - 1, rate)


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] < cut, _walk(low, x), _walk(high, x))


def boost(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, p: PiiParams) -> Model:
    """Trees on two thirds of the examples; the rest calibrates the sum and sets the thresholds."""
    held = np.arange(len(x)) % 3 == 0
    xt, yt, z = x[~held], y[~held], np.zeros((~held).sum())
    model = Model([])
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-z))
        model.trees.append(_grow(xt, q - yt, q * (1 - q), p.depth, p.rate))
        z += _walk(model.trees[-1], xt)
    raw, truth = sum(_walk(t, x[held]) for t in model.trees), y[held]
    for _ in range(50):  # Platt's line, by Newton steps with a small ridge
        q = 1 / (1 + np.exp(-(model.slope * raw + model.shift)))
        g = np.array([(raw * (q - truth)).sum() + 1e-3 * (model.slope - 1), (q - truth).sum() + 1e-3 * model.shift])
        s = q * (1 - q)
        h = np.array([[(raw * raw * s).sum() + 1e-3, (raw * s).sum()], [(raw * s).sum(), s.sum() + 1e-3]])
        model.slope, model.shift = np.array([model.slope, model.shift]) - np.linalg.solve(h, g)
    prob = 1 / (1 + np.exp(-(model.slope * raw + model.shift)))
    for k, name in enumerate(KINDS):
        own = kinds[held] == k
        model.thresholds[name] = 1.01  # without examples nothing is added
        for cut in sorted(set(np.round(prob[own], 6)) | {0.5}, reverse=True):
            taken = own & (prob >= cut)
            if cut >= 0.5 and taken.any() and truth[taken].mean() >= p.precision:
                model.thresholds[name] = float(cut)
    return model


@functools.lru_cache(maxsize=4)
def _fit(spark: SparkSession, p: PiiParams) -> Model:
    book = [{"t": t, "s": s, "e": e, "y": y} for t, s, e, y in phrase_book(p)]
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(book)), "array<struct<t:string,s:bigint,e:bigint,y:int>>")).alias("b")).select("b.*")
    seen = rows.select("s", "e", "y", "t", F.explode(candidates(F.col("t"))).alias("c"))
    got = seen.select("s", "e", "y", F.col("c.start").alias("cs"), F.col("c.end").alias("ce"), *(v.alias(n) for n, v in zip(FEATURES, feature_values(F.col("c")), strict=True))).collect()
    x = np.array([[r[n] for n in FEATURES] for r in got], float)
    y = np.array([r.y == 1 and r.s == r.cs and r.e == r.ce for r in got], float)
    return boost(x, y, x[:, 0].astype(int), p)


def _case(tree, values: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(values[f] < cut, _case(low, values)).otherwise(_case(high, values))


def _ahead(base: Column, found: Column) -> Column:
    """For each candidate the number of base spans of a sorted array that begin where it does or before: one sort."""
    place = lambda x, t: F.struct(x["start"].alias("start"), F.lit(t).alias("t"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: place(x, 0)), F.transform(found, lambda x: place(x, 1))))
    own = F.filter(F.transform(both, lambda x, i: F.struct(x["t"].alias("t"), i.alias("i"))), lambda x: x["t"] == 1)
    return F.transform(own, lambda x, k: x["i"] - k)


def _hits(base: Column, found: Column, ahead: Column) -> Column:
    """For each candidate whether a base span overlaps it. Those of a kind don't overlap, so the two beside it decide."""

    def hits(x):
        def hit(c, k):
            r = x["ahead"][k]
            return F.coalesce(F.get(x["base"], r - 1)["end"] > c["start"], F.lit(False)) | F.coalesce(F.get(x["base"], r)["start"] < c["end"], F.lit(False))

        return F.transform(x["found"], hit)

    # Bound once: the optimiser may put a column's expression in the place of its name, inside a lambda as well.
    return let(F.struct(base.alias("base"), found.alias("found"), ahead.alias("ahead")), hits)


def judged(c: Column, model: Model) -> Column:
    """The candidate with its probability."""
    features = F.array(*feature_values(c))
    total = lambda f: functools.reduce(lambda a, b: a + b, (_case(t, [f[i] for i in range(len(FEATURES))]) for t in model.trees))
    prob = lambda f: 1 / (1 + F.exp(-(F.lit(model.slope) * total(f) + F.lit(model.shift))))
    return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["m"].alias("m"), let(features, prob).alias("p"))


def best(taken: Column) -> Column:
    """Of sorted candidates with their probabilities those that no likelier one overlaps."""
    rank = lambda c: F.struct(c["p"], -c["start"], -c["kind"])
    beats = lambda o, c: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (rank(o) > rank(c))
    near = lambda all_, i: F.slice(all_, F.greatest(i + 1 - _NEAR, F.lit(1)), F.lit(2 * _NEAR + 1))
    kept = let(taken, lambda all_: F.filter(all_, lambda c, i: ~F.exists(near(all_, i), lambda o: beats(o, c))))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["m"].alias("m")))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat(names[x["kind"]], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))))


def _with_spans(documents: DataFrame, p: PiiParams) -> DataFrame:
    """All columns and, by names of its own, the text without null and its spans.

    Each step is a column of its own, which the plan computes once. All steps are sorts and passes over a text's spans."""
    model = _fit(documents.sparkSession, p)
    text, col = F.col("_pii_text"), lambda n, k="": F.col(f"_pii_{n}{k}")
    out = documents.withColumn("_pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumns({f"_pii_base_{k}": base_of(text, k) for k in KINDS} | {"_pii_found": candidates(text)})
    out = out.withColumns({f"_pii_ahead_{k}": _ahead(col("base_", k), col("found")) for k in KINDS})
    out = out.withColumns({f"_pii_hits_{k}": _hits(col("base_", k), col("found"), col("ahead_", k)) for k in KINDS})
    hits = F.struct(col("found").alias("found"), *(col("hits_", k).alias(k) for k in KINDS))
    free = let(hits, lambda x: F.filter(x["found"], lambda c, i: ~functools.reduce(lambda a, b: a | b, (x[k][i] for k in KINDS))))
    cuts = F.array(*(F.lit(model.thresholds[k]) for k in KINDS))
    out = out.withColumn("_pii_taken", F.filter(F.transform(free, lambda c: judged(c, model)), lambda c: c["p"] >= cuts[c["kind"]]))
    out = out.withColumn("_pii_base", F.array_sort(F.concat(*(col("base_", k) for k in KINDS))))
    return out.withColumn("_pii_spans", F.array_sort(F.concat("_pii_base", best(col("taken")))))


def redact_documents(documents: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """The same rows and columns with each span of text replaced by its mark; a null text stays null."""
    found = _with_spans(documents, p)
    found = found.withColumn("_pii_cut", to_cut(F.col("_pii_spans"))).withColumn("_pii_chunks", F.when(F.size("_pii_cut") > 0, chunks(F.col("_pii_text"))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), redact(F.col("_pii_text"), F.col("_pii_cut"), F.col("_pii_chunks")))).select(*documents.columns)


def find(documents: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text, base and spans (arrays of start, kind, end, m; sorted by start, kind).

    Defined cases: a null text counts as empty and has no spans; positions are code points, ends exclusive; repeated rows
    and null ids are treated like others; an empty table gives no rows; other columns are ignored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(docs, p).select("doc_id", F.col("_pii_text").alias("text"), F.col("_pii_base").alias("base"), F.col("_pii_spans").alias("spans"))


def to_cut(spans: Column) -> Column:
    """Of sorted spans those that begin behind all before them, with `from`, where the text goes on ahead of each; and at
    the end one without a kind, for the rest of the text. Overlapping spans become one, of the first's kind."""
    ahead = lambda all_: most_before(F.transform(all_, lambda x: x["end"]))
    cut = lambda all_: let(ahead(all_), lambda m: F.filter(F.transform(all_, lambda x, i: F.struct(m[i].alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"]))
    rest = lambda all_: F.struct(F.array_max(F.transform(all_, lambda x: x["end"])).alias("from"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("kind"))
    return F.when(F.size(spans) > 0, let(spans, lambda all_: F.concat(cut(all_), F.array(rest(all_))))).otherwise(F.array().cast("array<struct<from:bigint,start:bigint,kind:int>>"))


def chunks(text: Column) -> Column:
    """A text in pieces of _CHUNK code points, so that no place in it is far from the beginning of a piece."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), 0)


def _piece(parts: Column, a: Column, b: Column) -> Column:
    """The code points a to b, b exclusive, of a text in chunks; to its end if b is null."""
    i = F.floor(a / _CHUNK).cast("int")
    j = F.coalesce(F.floor((b - 1) / _CHUNK).cast("int"), F.size(parts) - 1)
    head = F.coalesce(F.get(parts, i), F.lit(""))
    off = (a - i * _CHUNK).cast("int")
    last = F.when(b.isNull(), F.coalesce(F.get(parts, j), F.lit(""))).otherwise(F.substring(F.coalesce(F.get(parts, j), F.lit("")), F.lit(1), (b - j * _CHUNK).cast("int")))
    middle = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    inside = F.substring(head, off + 1, F.coalesce((b - a).cast("int"), F.lit(_CHUNK)))
    return F.when(b <= a, "").when(i >= j, inside).otherwise(F.concat(F.substring(head, off + 1, F.lit(_CHUNK)), middle, last))


def redact(text: Column, cut: Column, parts: Column) -> Column:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] in place of what to_cut names; parts are the text's chunks."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    pieces = lambda x: F.transform(x["cut"], lambda c: F.concat(_piece(x["parts"], c["from"], c["start"]), F.coalesce(F.get(marks, c["kind"]), F.lit(""))))
    return F.when(F.size(cut) == 0, text).otherwise(F.array_join(let(F.struct(cut.alias("cut"), parts.alias("parts")), pieces), ""))


def _counts() -> list[Column]:
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k))
    return [of(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *_counts(), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def pii_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that SQL can express: those of the base spans, which the same operator gives."""
    return op4_pii(spark, sf_dir).drop("spans")


def _base_sql(kind: str) -> str:
    """DuckDB SQL: the valid matches of a kind, placed by what lies between the matches."""
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    checks = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST(x AS INTEGER) END)) <= 255",
        "card": f"length({number}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({number}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({number})[i] AS INTEGER) ELSE list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], CAST(reverse({number})[i] AS INTEGER) + 1) END)) % 10 = 0",
        "phone": f"length({number}) BETWEEN 10 AND 15",
    }
    return f"""SELECT doc_id, rid, {KINDS.index(kind)} AS kind, upto - length(m) AS a, upto AS b FROM (
      SELECT doc_id, rid, m, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda g: length(g))) AS upto
      FROM (SELECT doc_id, rid, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, rid, regexp_extract_all(text, '{forms[kind]}') AS ms, string_split_regex(text, '{forms[kind]}') AS gaps FROM d))) WHERE {checks[kind]}"""


PII_BASE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_base_sql(k) for k in KINDS)}),
g AS (SELECT rid, string_agg(['{"', '".join(KINDS)}'][kind + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, kind) AS joined, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))} FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{name}, 0) AS BIGINT) AS n_{name}" for name in KINDS)}, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN g ON g.rid = d.rid
"""
