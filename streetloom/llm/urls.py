"""URL filters: curated rules, and a path-template tree that carries their labels to the urls without a rule.

Per host the distinct paths are read level by level. At each node of the tree a segment that holds at least the square root
of the node's urls is a literal branch and every other one is variable, a wildcard. Literal branches with labels, or
without any, are put into the order of their share of bad urls, and neighbours become one branch unless a test tells them
apart: in that share, or in what stands below them (how many urls go on deeper, how many of the next segments hold a digit,
how long these are). A url's template is its way through the tree; a node with fewer paths than `support` is not parted.

A template's purity is the share of bad among its labelled urls, smoothed step by step: by that of the same path's template
in the trees of the parent domains, which pool their hosts' paths (b.com, com, all), if any of these has labels; otherwise
by that of its ancestors in its own tree, and these by the host's and the parent domains'. It rejects the template above a
threshold.

Only counts by node meet in an aggregate, and literal branches are at most the square root of a node's urls, so a hot host
never has its urls in one task. Rounds go as deep as some node has `support` different paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table


@dataclass(frozen=True)
class Rule:
    """Holds for `text`'s host, its subdomains, and paths that start like its path."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[Rule, ...] = (Rule("org/", True), Rule("example.org/es/", False), Rule("example.org/en/1", False), Rule("com/fr/", True), Rule("com/de/", False))
    #: A literal segment holds at least this many of its node's urls; a node is parted if it has as many paths.
    support: int = 3
    #: Critical value of the tests.
    z: float = 1.96
    #: Weight, in urls, of what a share is smoothed by.
    smooth: float = 4.0
    reject: float = 0.6


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without a ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The text of the longest rule that fits, or null, and whether it allows. Rules are curated: tens, not millions."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, allow = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return text, allow


def _apart(a: str, n: str, b: str, m: str, z: float) -> str:
    """SQL: whether the proportions a / n and b / m differ by a two-proportion test."""
    rate, whole = lambda x, y: f"({x} / nullif({y}, 0))", f"(({a} + {b}) / nullif({n} + {m}, 0))"
    error = f"sqrt(greatest({whole} * (1 - {whole}), CAST(0 AS DOUBLE)) * (CAST(1 AS DOUBLE) / nullif({n}, 0) + CAST(1 AS DOUBLE) / nullif({m}, 0)))"
    return f"coalesce(abs({rate(a, n)} - {rate(b, m)}) > {z} * {error}, false)"


def _longer(s: str, q: str, n: str, t: str, r: str, m: str, z: float) -> str:
    """SQL: whether the means s / n and t / m differ, given the sums of squares q and r."""
    spread = lambda s, q, n: f"greatest({q} / nullif({n}, 0) - ({s} / nullif({n}, 0)) * ({s} / nullif({n}, 0)), CAST(0 AS DOUBLE)) / nullif({n}, 0)"
    return f"coalesce(abs({s} / nullif({n}, 0) - {t} / nullif({m}, 0)) > {z} * sqrt({spread(s, q, n)} + {spread(t, r, m)}), false)"


def _differ(z: float) -> str:
    """SQL: whether a branch differs from the one before it, whose columns begin with p_."""
    tests = [_apart("bad", "lab", "p_bad", "p_lab", z), _apart("deeper", "n", "p_deeper", "p_n", z), _apart("digits", "deeper", "p_digits", "p_deeper", z), _longer("chars", "squares", "deeper", "p_chars", "p_squares", "p_deeper", z)]
    return f"p_n is null or {' or '.join(tests)}"


_SUMS = ("n", "bad", "lab", "deeper", "digits", "chars", "squares")


def _branches(rows: DataFrame, d: int, p: UrlParams) -> DataFrame:
    """The literal branches of level d: (dom, node, s, token), token naming the merged branch."""
    below = F.try_element_at("segs", F.lit(d + 2))
    long = F.length(below).cast("double")
    seen = rows.select("dom", "node", F.col("segs")[d].alias("s"), *(F.col(c).cast("double").alias(c) for c in ("n", "bad", "lab")), below.isNotNull().cast("double").alias("on"), F.rlike(below, F.lit("[0-9]")).cast("double").alias("digit"), long.alias("long"))
    here = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("lab").alias("lab"), F.sum(F.col("n") * F.col("on")).alias("deeper"), *(F.coalesce(F.sum(F.col("n") * x), F.lit(0.0)).alias(c) for c, x in (("digits", F.col("digit")), ("chars", F.col("long")), ("squares", F.col("long") * F.col("long"))))]
    children = materialise(seen.groupBy("dom", "node", "s").agg(*here), "url-children")
    totals = children.groupBy("dom", "node").agg(F.sum("n").alias("total"))
    literal = children.join(totals, ["dom", "node"]).where((F.col("n") >= p.support) & (F.col("n") * F.col("n") >= F.col("total")))
    # At most the square root of the node's urls meet in these windows.
    order = W.partitionBy("dom", "node", F.col("lab") > 0).orderBy((F.col("bad") / F.greatest("lab", F.lit(1.0))), "s")
    before = literal.select("*", *(F.lag(c).over(order).alias(f"p_{c}") for c in _SUMS))
    grouped = before.withColumn("g", F.sum(F.expr(_differ(p.z)).cast("int")).over(order)).withColumn("known", F.col("lab") > 0)
    names = F.array_join(F.array_sort(F.collect_set("s").over(W.partitionBy("dom", "node", "known", "g"))), ",")
    return grouped.select("dom", "node", "s", F.when(F.contains(names, F.lit(",")), F.concat(F.lit("{"), names, F.lit("}"))).otherwise(names).alias("token"))


def templates(paths: DataFrame, p: UrlParams) -> DataFrame:
    """Different rows (dom, path) with numbers n, bad and lab -> these and `way`, the nodes from the root to the template."""
    segs = F.filter(F.split("path", "/", -1), lambda s: s != "")
    state = paths.withColumn("segs", segs).withColumn("way", F.array(F.lit(""))).withColumn("node", F.lit(""))
    done, d = None, 0
    while True:
        sizes = state.groupBy("dom", "node").agg(F.count("*").alias("paths"))
        state = materialise(state.join(sizes, ["dom", "node"]).withColumn("open", (F.size("segs") > d) & (F.col("paths") >= p.support)).drop("paths"), "url-paths")
        ended = state.where(~F.col("open")).select("dom", "path", "n", "bad", "lab", F.when(F.size("segs") > d, F.concat("way", F.array(F.concat("node", F.lit("/**"))))).otherwise(F.col("way")).alias("way"))
        done = ended if done is None else done.union(ended)
        state = state.where("open")
        if state.isEmpty():
            return done
        branch = materialise(_branches(state, d, p), "url-branches")
        step = state.withColumn("s", F.col("segs")[d]).join(branch, ["dom", "node", "s"], "left")
        node = F.concat("node", F.lit("/"), F.coalesce("token", F.lit("*")))
        state = step.select("dom", "path", "n", "bad", "lab", "segs", F.concat("way", F.array(node)).alias("way"), node.alias("node"))
        d += 1


def domains(host: Column) -> Column:
    """array<string>: a host, its parent domains, and '' for all hosts."""
    parts = F.split(host, r"\.", -1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(0))), ".")))


def _folded(steps: Column, smooth: float) -> Column:
    """Smoothing by steps (lab, bad), the first one outermost, as f, g: f * prior + g is the smoothed share."""
    start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("g"))

    def step(acc, x):
        f = smooth / (x["lab"] + smooth)
        return F.struct((acc["f"] * f).alias("f"), (acc["g"] * f + x["bad"] / (x["lab"] + smooth)).alias("g"))

    return F.aggregate(steps, start, step)


def judged_paths(paths: DataFrame, p: UrlParams) -> DataFrame:
    """Different rows (host, path) with numbers n, bad and lab (labelled) of urls -> host, path, template, purity."""
    levels = paths.select("*", F.posexplode(domains(F.col("host"))).alias("i", "dom"))
    pooled = levels.groupBy("dom", "path").agg(*(F.sum(c).cast("double").alias(c) for c in ("n", "bad", "lab")))
    tree = materialise(templates(pooled, p).withColumn("template", F.element_at("way", -1)), "url-trees")
    # Counts of all nodes, the templates among them.
    nodes = materialise(tree.select("bad", "lab", "dom", F.explode("way").alias("node")).groupBy("dom", "node").agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab")), "url-nodes")
    whole = (F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("lab"), F.lit(0.0)) + 2)
    overall = nodes.where("dom = '' and node = ''").agg(whole.alias("overall"))
    steps = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "lab", "bad"))), lambda x: F.struct(x["lab"].alias("lab"), x["bad"].alias("bad")))
    # A template's ancestors, without itself, and ahead of them the roots of the parent domains.
    ways = tree.select("dom", "template", "way").distinct()
    above = ways.select("dom", "template", F.posexplode(F.slice("way", 1, F.greatest(F.size("way") - 1, F.lit(1)))).alias("o", "node")).join(nodes, ["dom", "node"])
    above = above.groupBy("dom", "template").agg(steps("o").alias("above"))
    roots = nodes.where("node = ''").select("dom", "bad", "lab")
    up = roots.select(F.col("dom").alias("host"), F.posexplode(domains(F.col("dom"))).alias("i", "dom")).where("host <> dom").join(roots, "dom")
    up = up.withColumn("o", -F.col("i")).groupBy(F.col("host").alias("dom")).agg(steps("o").alias("up"))
    counted = tree.select("dom", "template").distinct().join(nodes.withColumnRenamed("node", "template"), ["dom", "template"]).join(above, ["dom", "template"]).join(up, "dom", "left")
    own = F.concat(F.coalesce("up", F.array().cast("array<struct<lab:double,bad:double>>")), "above")
    counted = materialise(counted.select("dom", "template", "bad", "lab", _folded(own, p.smooth).alias("tree")), "url-templates")
    # Each path with its template's counts at its host and at the parent domains.
    found = levels.select("host", "path", "i", "dom").join(tree.select("dom", "path", "template"), ["dom", "path"]).join(counted, ["dom", "template"])
    own = F.min_by(F.struct("template", "lab", "bad", "tree"), "i")
    parents = F.array_sort(F.collect_list(F.when(F.col("i") > 0, F.struct((-F.col("i")).alias("o"), "lab", "bad"))))
    both = found.groupBy("host", "path").agg(own.alias("own"), parents.alias("parents")).crossJoin(F.broadcast(overall))  # overall is one row
    above = F.when(F.exists("parents", lambda x: x["lab"] > 0), _folded(F.transform("parents", lambda x: F.struct(x["lab"].alias("lab"), x["bad"].alias("bad"))), p.smooth)).otherwise(F.col("own.tree"))
    prior = above["f"] * F.col("overall") + above["g"]
    purity = (F.col("own.bad") + p.smooth * prior) / (F.col("own.lab") + p.smooth)
    return both.select("host", "path", F.when(F.col("own.template") == "", "/").otherwise(F.col("own.template")).alias("template"), purity.alias("purity"))


def judge(pages: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, template, purity (share of bad).

    Urls with a rule get its verdict and are the labelled ones; the others are blocked if their template's purity is
    p.reject or more. Defined cases: a null url, or one without ://, has an empty host and path and the template /, like
    other urls with an empty path; a rule needs a path that starts with /, so a url without a path has none; a template
    ends in ** where a path goes on below a node with too few paths to part; repeated rows and null ids are judged like
    others and repeat their label; an empty table gives no rows; other columns are ignored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    text, allow = rule_of(F.col("host"), F.col("path"), p.rules)
    rows = rows.withColumn("rule", text).withColumn("bad", F.when(allow, 0).when(~allow, 1))
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("lab")), "url-different")
    judged = rows.join(materialise(judged_paths(paths, p), "url-judged"), ["host", "path"])
    verdict = F.when(F.col("bad") == 1, "block").when(F.col("bad") == 0, "allow").when(F.col("purity") >= p.reject, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op2_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(what) -> str:
    """CASE for the longest rule that fits."""
    p = UrlParams()
    rows = "".join(f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {what(r)}" for r in sorted(p.rules, key=lambda r: (len(r.text), r.text), reverse=True))
    return f"CASE{rows} END"


_FOLD = "list_reduce([{'f': CAST(1 AS DOUBLE), 'g': CAST(0 AS DOUBLE)}] || %s, lambda p, q: {'f': p.f * q.f, 'g': p.g * q.f + q.g})"

OP2_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, {_rule_sql(lambda r: f"'{r.text}'")} AS rule, {_rule_sql(lambda r: int(not r.allow))} AS bad FROM r),
u AS (SELECT host, path, CAST(count(*) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, CAST(count(bad) AS DOUBLE) AS lab FROM j GROUP BY host, path),
lv AS (SELECT * FROM (SELECT *, array_to_string(string_split(host, '.')[i + 1:], '.') AS dom FROM (SELECT *, unnest(range(0, len(string_split(host, '.')) + 1)) AS i FROM u)) QUALIFY i = min(i) OVER (PARTITION BY host, path, dom)),
pooled AS (SELECT dom, path, sum(n) AS n, sum(bad) AS bad, sum(lab) AS lab FROM lv GROUP BY dom, path),
st AS (
  SELECT 0 AS d, dom, path, n, bad, lab, segs, [''] AS way, '' AS node, len(segs) > 0 AND count(*) OVER (PARTITION BY dom) >= {UrlParams().support} AS open
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM pooled)
  UNION ALL
  SELECT d + 1, dom, path, n, bad, lab, segs, way || [next], next, len(segs) > d + 1 AND count(*) OVER (PARTITION BY dom, next) >= {UrlParams().support}
  FROM (
    SELECT x.*, x.node || '/' || coalesce(b.token, '*') AS next
    FROM (SELECT * FROM st WHERE open) x LEFT JOIN (
      SELECT dom, node, s, CASE WHEN contains(names, ',') THEN '{{' || names || '}}' ELSE names END AS token
      FROM (
        SELECT *, array_to_string(list_sort(list_distinct(list(s) OVER (PARTITION BY dom, node, lab > 0, g))), ',') AS names
        FROM (
          SELECT *, sum(CASE WHEN {_differ(UrlParams().z)} THEN 1 ELSE 0 END) OVER (PARTITION BY dom, node, lab > 0 ORDER BY bad / greatest(lab, 1), s) AS g
          FROM (
            SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in _SUMS)}
            FROM (
              SELECT * FROM (SELECT dom, node, segs[d + 1] AS s, sum(n) AS n, sum(bad) AS bad, sum(lab) AS lab, sum(CASE WHEN len(segs) > d + 1 THEN n ELSE 0 END) AS deeper,
                coalesce(sum(CASE WHEN regexp_matches(segs[d + 2], '[0-9]') THEN n ELSE 0 END), 0) AS digits,
                coalesce(sum(n * CAST(length(segs[d + 2]) AS DOUBLE)), 0) AS chars, coalesce(sum(n * (CAST(length(segs[d + 2]) AS DOUBLE) * length(segs[d + 2]))), 0) AS squares
              FROM st WHERE open GROUP BY d, dom, node, segs[d + 1]) QUALIFY n >= {UrlParams().support} AND n * n >= sum(n) OVER (PARTITION BY dom, node))
            WINDOW w AS (PARTITION BY dom, node, lab > 0 ORDER BY bad / greatest(lab, 1), s))))) b
    ON b.dom = x.dom AND b.node = x.node AND b.s = x.segs[x.d + 1])),
t AS (SELECT dom, path, bad, lab, CASE WHEN len(segs) > d THEN way || [node || '/**'] ELSE way END AS way FROM st WHERE NOT open),
nodes AS (SELECT dom, node, sum(bad) AS bad, sum(lab) AS lab FROM (SELECT dom, bad, lab, unnest(way) AS node FROM t) GROUP BY dom, node),
steps AS (SELECT dom, node, bad, lab, {{'f': {UrlParams().smooth} / (lab + {UrlParams().smooth}), 'g': bad / (lab + {UrlParams().smooth})}} AS x FROM nodes),
o AS (SELECT (bad + 1) / (lab + 2) AS overall FROM nodes WHERE dom = '' AND node = ''),
doms AS (SELECT DISTINCT dom FROM nodes),
up AS (
  SELECT a.dom, list(s.x ORDER BY a.i DESC) AS x
  FROM (SELECT *, array_to_string(string_split(dom, '.')[i + 1:], '.') AS parent FROM (SELECT dom, unnest(range(1, len(string_split(dom, '.')) + 1)) AS i FROM doms)
    QUALIFY i = min(i) OVER (PARTITION BY dom, parent)) a JOIN steps s ON s.dom = a.parent AND s.node = '' WHERE a.parent <> a.dom GROUP BY a.dom),
k AS (SELECT DISTINCT dom, way, way[-1] AS template FROM t),
above AS (
  SELECT a.dom, a.template, list(s.x ORDER BY a.i) AS x
  FROM (SELECT dom, template, way, unnest(range(1, greatest(len(way) - 1, 1) + 1)) AS i FROM k) a JOIN steps s ON s.dom = a.dom AND s.node = a.way[a.i] GROUP BY a.dom, a.template),
c AS (SELECT k.dom, k.template, s.bad, s.lab, s.x, {_FOLD % "coalesce(up.x, []) || above.x"} AS tree
  FROM k JOIN steps s ON s.dom = k.dom AND s.node = k.template JOIN above ON above.dom = k.dom AND above.template = k.template LEFT JOIN up ON up.dom = k.dom),
f AS (
  SELECT lv.host, lv.path, arg_min({{'bad': c.bad, 'lab': c.lab, 'tree': c.tree}}, i) AS own, list(c.x ORDER BY i DESC) FILTER (i > 0) AS parents, max(c.lab) FILTER (i > 0) AS known
  FROM lv JOIN t ON t.dom = lv.dom AND t.path = lv.path JOIN c ON c.dom = t.dom AND c.template = t.way[-1] GROUP BY lv.host, lv.path),
q AS (SELECT host, path, own, CASE WHEN known > 0 THEN {_FOLD % "parents"} ELSE own.tree END AS a FROM f)
SELECT page_id, j.host, j.path, rule, CASE WHEN j.bad = 1 THEN 'block' WHEN j.bad = 0 THEN 'allow'
  WHEN (own.bad + {UrlParams().smooth} * (a.f * overall + a.g)) / (own.lab + {UrlParams().smooth}) >= {UrlParams().reject} THEN 'block' ELSE 'allow' END AS verdict
FROM j JOIN q ON q.host = j.host AND q.path = j.path, o
"""
