"""URL filter by path-template trees.

Explicit rules (host, path) come first: a rule fits its host and all subdomains if the path starts with the rule's; the
longest fitting rule decides. All other URLs are judged by their template: per host, the path's segments form a tree, in
which a segment becomes a wildcard if its shape says so (digits, hexadecimal or mixed ids), if its siblings are too many and too
rare to be names, or if its branch's labelled outcomes can't be told from its siblings' (two-proportion test). A template
is rejected if its purity, the labelled share of good pages smoothed towards the host's and that towards the overall
share, is under a threshold. Counts by (host, path shape) are pre-aggregated, and the trees are walked over those counts, never
over the pages, from fork to fork: segments that all paths below a node share are passed at once, and a node with one path is
done, so there are as many rounds as forks on a path, however deep it is. A host of any size stays spread.

Defined results: null URLs and URLs without ``://`` have empty host and path, fit no rule and are judged like other URLs
without labels (allowed unless most labelled pages are bad); a page's label is good unless any of its labels is bad;
paths are walked whole; repeated rows count as often as they occur; extra columns pass through, those named like results are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.llm.common import attach, discard, materialize, tidy, written

#: Siblings are variable if there are so many of them and so few rows for each on average.
MANY, RARE = 50, 3.0
#: Branches are alike if their share of good pages is within so many standard errors of all siblings'.
ALIKE = 2.58
#: Pseudo-counts of labelled pages that smoothing adds.
STRENGTH = 10.0
LEAST_PURITY = 0.5


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else null. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments with what is variable by its looks as wildcards."""
    text = F.regexp_replace(path, r"(?i)(?<=/)(?:[0-9a-f]{8}-[0-9a-f\-]{27}|(?=[a-z]*+[0-9])[0-9a-f]{12,}+)(?=[/.]|$)", "{id}")
    return F.split(F.regexp_replace(F.regexp_replace(text, r"[0-9]++", "{n}"), "^/", ""), "/")


SUMS = ("n", "good", "seen")


def _grown(tree: DataFrame) -> DataFrame:
    """``tree`` (host, shape, left: segments to come, node: host and template, n, good, seen, open) with the open nodes one fork on."""
    ends = tree.filter("open").groupBy("node").agg(F.min("left").alias("lo"), F.max("left").alias("hi"), F.count("*").alias("m"))
    same = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1
    ends = materialize(ends.select("node", "m", F.when(F.col("lo") == F.col("hi"), -1).otherwise(same).cast("int").alias("same")), "url-ends")
    stars = lambda k: F.concat("node.template", F.repeat(F.lit("/*"), k))
    step = attach(tree.filter("open"), ends, "node", "m", "url-step")
    one = step.filter("same < 0").select("host", "shape", "left", F.struct("host", stars(F.size("left")).alias("template")).alias("node"), *SUMS, F.lit(False).alias("open"))
    step = step.filter("same >= 0").select("host", "shape", F.struct("host", stars(F.col("same")).alias("template")).alias("node"), *SUMS, F.get("left", F.col("same")).alias("segment"), F.slice("left", F.col("same") + 2, F.size("left")).alias("left"))
    step = materialize(step.withColumn("at", F.struct("node", F.coalesce("segment", F.lit("\x00")).alias("segment"))), "url-step")

    children = step.groupBy("at").agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("m"))
    children = materialize(children.select("at", "at.node", *SUMS, "m"), "url-children")
    parents = materialize(children.groupBy("node").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in SUMS]), "url-parents")
    both = attach(children, parents, "node", "kinds", "url-both")
    share = F.col("all_good") / F.col("all_seen")
    error = F.sqrt(share * (1 - share) * (1 / F.col("seen") + 1 / (F.col("all_seen") - F.col("seen"))))
    gap = F.abs(F.col("good") / F.col("seen") - (F.col("all_good") - F.col("good")) / (F.col("all_seen") - F.col("seen")))
    told_apart = F.when((F.col("seen") > 0) & (F.col("all_seen") > F.col("seen")), gap > ALIKE * error).otherwise(F.lit(False))
    variable = (F.col("kinds") >= MANY) & (F.col("all_n") < RARE * F.col("kinds"))
    named = F.when(F.col("at.segment") == "\x00", F.lit("")).when(variable | ~told_apart, F.lit("/*")).otherwise(F.concat(F.lit("/"), "at.segment"))
    both = materialize(both.select("at", "m", F.concat("node.template", named).alias("template")), "url-both")
    step = attach(step, both, "at", "m", "url-next").select("host", "shape", "left", F.struct("host", "template").alias("node"), *SUMS, F.col("segment").isNotNull().alias("open"))
    return step.unionByName(one)


def templates(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(at: host and shape, n, template, purity) of every host and shape. urls: host, shape, page key ``_page``; labels: ``_page``, ``good`` (0/1)."""
    counts = urls.groupBy("host", "shape", "_page").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col("_page").isNotNull() & F.col("good").isNotNull()).groupBy("_page").agg(F.min("good").alias("good"))
    labelled = counts.filter(F.col("_page").isNotNull()).join(marks, "_page").groupBy("host", "shape").agg(F.sum(F.col("good") * F.col("n")).cast("double").alias("good"), F.sum("n").cast("double").alias("seen"))
    tree = counts.groupBy("host", "shape").agg(F.sum("n").alias("n")).join(labelled, ["host", "shape"], "left").fillna(0.0, ["good", "seen"])
    tree = tree.select("host", "shape", F.col("shape").alias("left"), F.struct("host", F.lit("").alias("template")).alias("node"), *SUMS, F.lit(True).alias("open"))
    tree, done = materialize(tree, "url-tree"), None
    while tree.filter("open").limit(1).count():
        mark = written()
        grown = materialize(_grown(tree), "url-tree")
        ended = materialize(grown.filter("NOT open"), "url-done")
        tidy(mark, grown, ended)
        discard(tree)
        tree, done = grown, ended if done is None else done.unionByName(ended)
    tree = (tree if done is None else done).select("host", "shape", "node.template", *SUMS)
    overall = tree.agg(F.sum("good").alias("g"), F.sum("seen").alias("s")).first()
    prior = (overall["g"] + 1.0) / (overall["s"] + 1.0) if overall["s"] else 1.0
    hosts = tree.groupBy("host").agg(((F.sum("good") + STRENGTH * prior) / (F.sum("seen") + STRENGTH)).alias("host_purity"))
    kinds = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("seen").alias("s")).join(hosts, "host")
    kinds = kinds.select("host", "template", ((F.col("g") + STRENGTH * F.col("host_purity")) / (F.col("s") + STRENGTH)).alias("purity"))
    return tree.join(kinds, ["host", "template"]).select(F.struct("host", "shape").alias("at"), "n", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", page: Column | None = None) -> DataFrame:
    """``pages`` plus host, path, template, purity, rule and verdict (columns of these names are replaced).

    ``page``: what identifies a page in ``labels._page``.
    """
    new = ("host", "path", "template", "purity", "rule", "verdict")
    kept = [c for c in pages.columns if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    df = pages.select(row.alias("_row"), F.col(f"`{url}`").alias("_url"), (page if page is not None else F.lit(None).cast("long")).alias("_page"))
    df = df.select("_row", "_page", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")).withColumn("shape", shape(F.col("path")))
    mark = written()
    found = materialize(templates(df.select("host", "shape", "_page"), labels), "url-templates")
    tidy(mark, found)
    df = attach(df.withColumn("at", F.struct("host", "shape")), found, "at", "n", "url-pages")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return df.select("_row.*", "host", "path", "template", "purity", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
