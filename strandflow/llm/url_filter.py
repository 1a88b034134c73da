"""URL filter: per-host path-template tree with smoothed labelled purity, and explicit rules before it.

The tree grows from each host to the deepest path's last segment. Under one node the segments, with runs of
digits as `*`, are its branches. A node with FANOUT different branches or more is variable: they become one wildcard. Otherwise the
branches with LEAST labelled rows or more are put in order of their bad share, and neighbours that a two-proportion test does not tell apart
(ALIKE standard errors) are merged: they are one branch from there on, and so are their subtrees. A node's purity is its labelled
rows' bad share, smoothed towards its parent's purity with a weight of WEIGHT rows, and a host's towards PRIOR; so a branch with few labels or none
is judged as what stands above it. A url whose deepest node has a purity over PURITY is blocked.

DataFrame functions only. Null or malformed urls have an empty host and path and fall to the method. Very long urls make deep paths, which take no more
rounds than short ones unless choices lie above one another, or long segments. Of rules that fit, the longest wins; rules of equal length cannot both fit unless they are equal or cut differently into
host and path, and then the later text in order wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
FANOUT, PRIOR, WEIGHT, PURITY, LEAST, ALIKE = 20, 0.1, 2.0, 0.5, 5, 2.0


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds rule and rule_action: the longest rule whose host is the url's host or a parent domain of it and whose path
    starts the url's path. Up to 200 rules are one expression; more are joined on the url's host suffixes."""
    if len(rules) <= 200:
        text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            text, action = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
        return urls.withColumns({"rule": text, "rule_action": action})
    spark = urls.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.text, r.action) for r in rules], "rule_host string, rule_path string, rule string, rule_action string")
    keys = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = keys.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    best = suffixes.join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_action")).alias("best"))
    return urls.join(best.select("host", "path", "best.rule", "best.rule_action"), ["host", "path"], "left")


def _purity(bad: Column, n: Column, above: Column) -> Column:
    return (bad + F.lit(WEIGHT) * above) / (n + F.lit(WEIGHT))


def branches(tree: DataFrame) -> DataFrame:
    """(host, parent, segment, wide, name, purity) of the branches under each node of tree (host, parent, above, segment, n, bad).

    A variable node has one row, with a null segment and the name `*`; the rows of merged branches share a name and a purity."""
    node = ("host", "parent", "above")
    kids = tree.groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    fans = kids.groupBy(*node).agg((F.count("*") >= FANOUT).alias("wide"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    wide = fans.where("wide").select("host", "parent", F.lit(None).cast("string").alias("segment"), "wide", F.lit("*").alias("name"), _purity(F.col("all_bad"), F.col("all_n"), F.col("above")).alias("purity"))
    few = kids.join(fans.where("not wide").select("host", "parent"), ["host", "parent"])
    # a node here has fewer than FANOUT branches, so these windows are small
    tested = few.withColumn("enough", F.col("n") >= LEAST).withColumn("share", F.when(F.col("enough"), F.col("bad") / F.col("n")))
    w = Window.partitionBy("host", "parent", "enough").orderBy("share", "segment")
    n0, bad0 = F.lag("n").over(w), F.lag("bad").over(w)
    tested = tested.withColumn("n0", n0).withColumn("bad0", bad0)
    pooled = F.try_divide(F.col("bad") + F.col("bad0"), F.col("n") + F.col("n0"))
    gap = F.col("share") - F.try_divide("bad0", "n0")
    alike = F.col("enough") & (gap * gap <= F.lit(ALIKE * ALIKE) * pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), "n") + F.try_divide(F.lit(1.0), "n0")))
    tested = tested.withColumn("group", F.sum(F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1)).over(w))
    g = Window.partitionBy("host", "parent", "enough", "group")
    named = tested.select("host", "parent", "segment", F.lit(False).alias("wide"), F.min("segment").over(g).alias("name"), _purity(F.sum("bad").over(g), F.sum("n").over(g), F.col("above")).alias("purity"))
    return named.unionByName(wide)


def advance(tree: DataFrame) -> DataFrame:
    """tree (host, masked, n, bad, parent, above, rest) with every row moved down to the first depth at which some node under its parent is variable or has branches
    that may merge, and `more`, whether segments are left there.

    Down to that depth nodes keep their branches apart, so counts of all prefixes, taken for all depths at once, give each node its purity. Prefixes are known by their hashes."""
    t = tree.withColumn("segments", F.split("rest", "/")).withColumn("size", F.size("segments"))
    heads = F.transform(F.sequence(F.lit(1), F.col("size")), lambda k: F.xxhash64(F.array_join(F.slice("segments", 1, k), "/")))
    t = t.withColumn("heads", heads)
    above = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("heads", 1, F.col("size") - 1))
    steps = t.select("host", "parent", "masked", "n", "bad", F.posexplode(F.arrays_zip(above.alias("node"), F.col("heads").alias("head"))).alias("k", "x")).select("host", "parent", "masked", "n", "bad", "k", "x.node", "x.head")
    kids = staged(steps.groupBy("host", "parent", "k", "node", "head").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-prefixes")
    fans = kids.groupBy("host", "parent", "k", "node").agg(F.count("*").alias("fan"), F.count_if(F.col("n") >= LEAST).alias("enough"))
    first = fans.where((F.col("fan") >= FANOUT) | (F.col("enough") > 1)).groupBy("host", "parent").agg(F.min("k").alias("first"))
    known = kids.select("host", "parent", "k", "head", F.col("n").alias("kn"), F.col("bad").alias("kb"))
    quiet = steps.join(first, ["host", "parent"], "left").where(F.col("first").isNull() | (F.col("k") < F.col("first")))
    chains = quiet.join(known, ["host", "parent", "k", "head"]).groupBy("host", "masked").agg(F.array_sort(F.collect_list(F.struct("k", "kn", "kb"))).alias("chain"))
    moved = t.join(first, ["host", "parent"], "left").join(chains, ["host", "masked"], "left").withColumn("a", F.least(F.coalesce("first", "size"), F.col("size")))
    purity = F.aggregate(F.coalesce("chain", F.array().cast("array<struct<k:int,kn:double,kb:double>>")), F.col("above"), lambda p, x: _purity(x["kb"], x["kn"], p))
    passed = F.when(F.col("a") > 0, F.concat("parent", F.lit("/"), F.array_join(F.slice("segments", 1, F.col("a")), "/"))).otherwise(F.col("parent"))
    rest = F.array_join(F.slice("segments", F.col("a") + 1, F.greatest(F.col("size") - F.col("a"), F.lit(0))), "/")
    return staged(moved.select("host", "masked", "n", "bad", passed.alias("parent"), purity.alias("above"), rest.alias("rest"), (F.col("a") < F.col("size")).alias("more")), "url-tree")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template, purity) of distinct (host, path, n, bad): the deepest node of each path and its purity.

    Rounds alternate between moving down to the next depth with a choice to make and making it, so their number is that of such depths above one another, not that of
    a path's segments. A row leaves the tree where its path ends."""
    t = paths.select("host", "path", F.regexp_replace("path", "[0-9]+", "*").alias("masked"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"))
    shapes = t.groupBy("host", "masked").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = shapes.groupBy("host").agg(_purity(F.sum("bad"), F.sum("n"), F.lit(PRIOR)).alias("above"))
    tree = staged(shapes.join(hosts, "host").select("host", "masked", "n", "bad", F.lit("").alias("parent"), "above", F.expr("substring(masked, 2)").alias("rest")), "url-tree")
    ended = None

    def leave(tree: DataFrame) -> DataFrame:
        nonlocal ended
        done = tree.where(~F.col("more")).select("host", "masked", F.col("parent").alias("template"), F.col("above").alias("purity"))
        ended = done if ended is None else ended.unionByName(done)
        return tree.where("more").drop("more")

    tree = leave(advance(tree))
    while not tree.isEmpty():
        tree = tree.withColumn("segment", F.substring_index("rest", "/", 1)).withColumn("more", F.instr("rest", "/") > 0)
        found = staged(branches(tree), "url-branches")
        whole = found.where("wide").select("host", "parent", F.lit(True).alias("wide"), F.col("name").alias("wide_name"), F.col("purity").alias("wide_purity"))
        single = found.where("not wide").select("host", "parent", "segment", "name", "purity")
        tree = tree.join(whole, ["host", "parent"], "left").join(single, ["host", "parent", "segment"], "left")
        node = F.concat("parent", F.lit("/"), F.coalesce("wide_name", "name"))
        tree = staged(tree.select("host", "masked", "n", "bad", node.alias("parent"), F.coalesce("wide_purity", "purity").alias("above"), F.expr("substring(rest, instr(rest, '/') + 1)").alias("rest"), "more"), "url-tree")
        tree = leave(tree)
        if not tree.isEmpty():
            tree = leave(advance(tree))
    return t.join(ended, ["host", "masked"]).select("host", "path", "template", "purity")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = (), labels: DataFrame | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of each row. labels: (key, bad 0/1), or None to learn from the rows that rules judge.

    Repeated rows are judged each; other columns of pages are not read. An empty table gives an empty result."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    rows = match_rules(rows, rules)
    if labels is None:
        paths = rows.groupBy("host", "path").agg(F.count("rule").alias("n"), F.sum(F.when(F.col("rule_action") == "block", 1).otherwise(0)).alias("bad"))
    else:
        known = rows.join(labels.select(F.col(key).alias("key"), F.col("bad").cast("int").alias("bad")).where("bad is not null"), "key", "left")
        paths = known.groupBy("host", "path").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = staged(paths, "url-paths")
    out = rows.join(templates(paths), ["host", "path"], "left")
    verdict = F.coalesce("rule_action", F.when(F.col("purity") > F.lit(PURITY), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


SQL_DEPTH = 5


def _depths() -> str:
    """A path's segments one after another as columns: node{d} and purity{d} of the first d of them; null where the path is shorter."""
    sql = ""
    for d in range(1, SQL_DEPTH + 1):
        sql += f"""
x{d} AS (SELECT *, seg[{d}] AS s FROM t{d - 1}),
k{d} AS (SELECT host, node AS parent, any_value(purity) AS above, s, sum(n) AS n, sum(bad) AS bad FROM x{d} WHERE s IS NOT NULL GROUP BY host, node, s),
c{d} AS (SELECT *, count(*) OVER (PARTITION BY host, parent) >= {FANOUT} AS wide, sum(n) OVER (PARTITION BY host, parent) AS an, sum(bad) OVER (PARTITION BY host, parent) AS ab FROM k{d}),
p{d} AS (SELECT *, lag(n) OVER w AS n0, lag(bad) OVER w AS b0 FROM c{d} WHERE NOT wide AND n >= {LEAST} WINDOW w AS (PARTITION BY host, parent ORDER BY bad / n, s)),
q{d} AS (SELECT *, CASE WHEN (bad / n - b0 / n0) ** 2 <= {ALIKE * ALIKE} * ((bad + b0) / (n + n0)) * (1 - (bad + b0) / (n + n0)) * (1 / n + 1 / n0) THEN 0 ELSE 1 END AS fresh FROM p{d}),
r{d} AS (SELECT *, sum(fresh) OVER (PARTITION BY host, parent ORDER BY bad / n, s ROWS UNBOUNDED PRECEDING) AS island FROM q{d}),
b{d} AS (SELECT host, parent, s, min(s) OVER v AS name, (sum(bad) OVER v + {WEIGHT} * above) / (sum(n) OVER v + {WEIGHT}) AS purity FROM r{d} WINDOW v AS (PARTITION BY host, parent, island)
  UNION ALL SELECT host, parent, s, s, (bad + {WEIGHT} * above) / (n + {WEIGHT}) FROM c{d} WHERE NOT wide AND n < {LEAST}
  UNION ALL SELECT host, parent, s, '*', (ab + {WEIGHT} * above) / (an + {WEIGHT}) FROM c{d} WHERE wide),
t{d} AS (SELECT x.host, x.masked, x.n, x.bad, x.seg, CASE WHEN x.s IS NULL THEN x.node ELSE x.node || '/' || b.name END AS node, coalesce(b.purity, x.purity) AS purity
  FROM x{d} x LEFT JOIN b{d} b ON x.host = b.host AND x.node = b.parent AND x.s = b.s),"""
    return sql


ORACLE_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(action, rh, rp) AS (VALUES {", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in RULES)}),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM b JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
rows_ AS (SELECT b.*, rule, action, regexp_replace(path, '[0-9]+', '*', 'g') AS masked FROM b LEFT JOIN f USING (page_id)),
m AS (SELECT host, masked, count(rule)::DOUBLE AS n, count(*) FILTER (action = 'block')::DOUBLE AS bad FROM rows_ GROUP BY host, masked),
h AS (SELECT host, (sum(bad) + {WEIGHT} * {PRIOR}::DOUBLE) / (sum(n) + {WEIGHT}) AS purity FROM m GROUP BY host),
t0 AS (SELECT m.host, masked, n, bad, string_split(substr(masked, 2), '/') AS seg, '' AS node, purity FROM m JOIN h ON m.host = h.host),{_depths()}
j AS (SELECT host, masked, purity FROM t{SQL_DEPTH})
SELECT page_id, rows_.host, rows_.path, rule, coalesce(action, CASE WHEN purity > {PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ JOIN j ON rows_.host = j.host AND rows_.masked = j.masked
"""
