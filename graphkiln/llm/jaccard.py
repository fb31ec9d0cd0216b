"""Exact n-gram Jaccard self-join by prefix filtering under several global token orders, and its groups.

A document is the set of its distinct word n-grams (64-bit hashes). If two sets have a Jaccard similarity of at least t,
then under *any* order of all n-grams they share an n-gram among the first n - ceil(t n) + 1 of each (the prefix). Three
orders are used, and candidates must pass all three before their whole sets are compared:

1. rare first. Frequencies are counted for the n-grams of a fixed share of the hash range (LOW; what lies there doesn't
   depend on the document). Those found in one document only come first, then the others by hash, then the frequent ones.
   A document whose prefix is all unique n-grams has no partner and is out after this count, which holds for most; and
   passages that many documents share are at the end, out of nearly all prefixes.
2. and 3. two other hash orders, checked on the candidate pairs.

Documents with equal sets are joined beforehand by a digest, so copies are one row however many there are. What is asked
for are the groups (connected components), so candidates are made in two rounds: first every document of an n-gram's list
against a few pivots of that list (linear); then, only in lists whose documents are not yet in one group, the pairs across
groups: by a join for short lists, by blocks for long ones. No link between groups can be missed, and within a group no
more pairs are needed.

Defined results: null and blank texts have no n-grams, n_shingles 0, and are groups of their own; texts with fewer words
than n are one n-gram, their whole sequence; rows that share an id are one node, whatever their texts; repeated rows are
copies; empty tables give no rows. Words are split at ASCII white space and only A to Z are lower-cased. A null id has a null
group and links nothing. Extra columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.functions.ship import ship
from graphkiln.llm.common import attach, bounded_broadcast, discard, filter_after, free_name, let, materialize, tidy, words, written
from graphkiln.llm.components import components

#: LOW's share of the hash range, as a multiple of the prefix's share of a set.
LOW = 1.5
#: N-grams in more documents than this are frequent: last in the first order.
FREQUENT = 40
#: Seeds of the orders by which the lists' pivots are chosen, by round.
PIVOTS = (range(3), range(3, 10))
#: Lists of more documents than this are compared by blocks of about so many documents and n-grams at most.
LARGE, BLOCK, BLOCK_GRAMS = 64, 1024, 1 << 21


def ngrams(text: Column, size: int) -> Column:
    """The sorted distinct hashes of a text's word n-grams."""

    def found(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        whole = F.array(F.xxhash64(F.lit("whole"), F.array_join(w, " ")))
        none = F.array().cast("array<bigint>")
        return F.sort_array(F.when(F.size(w) >= size, F.array_distinct(grams)).when(F.size(w) > 0, whole).otherwise(none))

    return let(words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)), found)


def sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc, set): each document's sorted distinct hashes."""
    return docs.select(F.col(f"`{key}`").alias("doc"), ngrams(F.col(f"`{text}`"), size).alias("set"))


def prefix_size(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def _alike(n: Column, m: Column, percent: int) -> Column:
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)


def _prefix(hashes: Column, seed: int, size: Column) -> Column:
    """The first tokens under the order of their hashes with a seed."""
    return F.slice(F.sort_array(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed)))), 1, size)


def _verify(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): first those that pass the second and third order, then their whole sets.

    known: doc, n, second, third, set. Only the sets of documents that are in pairs still are shuffled.
    """
    side = lambda x, columns: known.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    pairs = pairs.join(side("a", ("second", "third")), "a").join(side("b", ("second", "third")), "b")
    pairs = materialize(pairs.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b"), "jaccard-pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "jaccard-paired")
    known = known.join(bounded_broadcast(ids), "doc", "left_semi")
    both = pairs.join(side("a", ("n", "set")), "a").join(side("b", ("n", "set")), "b")
    both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("s"))
    return both.filter(F.col("s") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("s")) * percent).select("a", "b")


def _lists(ordered: DataFrame) -> DataFrame:
    """(doc, n, t): the prefixes, after what is frequent among the documents that are left was moved to the end as well.

    ordered: (doc, n, need, order). A stretch beyond the needed length is looked at first; only documents that have too
    few other n-grams in it are gone through whole.
    """
    stretch = materialize(ordered.select("doc", "n", "need", F.slice("order", 1, 2 * F.col("need") + 8).alias("order")), "jaccard-stretch")
    stretch = stretch.select("doc", "n", "need", F.posexplode("order").alias("at", "t"))
    busy = materialize(stretch.groupBy("t").count().filter(F.col("count") > FREQUENT).select("t", F.lit(True).alias("busy")), "jaccard-busy")
    busy = bounded_broadcast(busy)

    def first(tokens: DataFrame) -> DataFrame:
        marked = tokens.join(busy, "t", "left").select("doc", "n", "need", F.struct(F.coalesce("busy", F.lit(False)).alias("busy"), "at", "t").alias("x"))
        return marked.groupBy("doc", "n", "need").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("x", F.slice("x", 1, F.col("need")))

    start = materialize(first(stretch).withColumn("short", F.exists("x", lambda x: x["busy"])), "jaccard-start")
    done = start.filter("NOT short").select("doc", "n", "x")
    short = ordered.join(start.filter("short").select("doc"), "doc", "left_semi").select("doc", "n", "need", F.posexplode("order").alias("at", "t"))
    both = done.unionByName(first(short).select("doc", "n", "x"))
    return both.select("doc", "n", F.explode("x.t").alias("t"))


def _to_pivots(marked: DataFrame, seeds: range, percent: int) -> DataFrame:
    """Candidates (a, b): each document of a list with the list's first ones under several orders. marked: t, doc, n, of."""
    pivots = marked.groupBy("t").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("doc", F.lit(k)).alias("h"), "doc", "n", "of")) for k in seeds])).alias("pivots"), F.min("doc").alias("x"), F.max("doc").alias("y"))
    pivots = pivots.filter("x < y").select("t", F.explode("pivots").alias("p"))
    near = marked.join(pivots, "t").filter((F.col("of") != F.col("p.of")) & _alike(F.col("n"), F.col("p.n"), percent))
    return near.select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()


def _open(listed: DataFrame, links: DataFrame) -> DataFrame:
    """(t, doc, n, of: the document's group by ``links``) of the lists that are not of one group."""
    grouped = materialize(components(links), "jaccard-groups")
    marked = listed.join(grouped.select(F.col("id").alias("doc"), "component"), "doc", "left").select("t", "doc", "n", F.coalesce("component", "doc").alias("of"))
    open_ = marked.groupBy("t").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("t")
    return marked.join(open_, "t")


def _across(marked: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the groups of lists that are not of one group yet. marked: t, doc, n, of."""
    sizes = materialize(marked.groupBy("t").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).filter(F.col("m") > LARGE), "jaccard-large")
    sizes = bounded_broadcast(sizes)
    small = marked.join(sizes, "t", "left_anti")
    other = small.select("t", F.col("doc").alias("doc_2"), F.col("n").alias("n_2"), F.col("of").alias("of_2"))
    pairs = small.join(other, (small["t"] == other["t"]) & (F.col("of") < F.col("of_2")) & _alike(F.col("n"), F.col("n_2"), percent))
    pairs = pairs.select(F.least("doc", "doc_2").alias("a"), F.greatest("doc", "doc_2").alias("b")).distinct()
    return _verify(pairs, known, percent).unionByName(_blocks(marked.join(sizes, "t"), known, percent))


def _blocks(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within large lists: blocks of their documents against blocks, each pair in the first list it shares.

    rows: t, doc, n, of, m and grams (the list's documents and their n-grams). A task holds two blocks of about ``BLOCK``
    documents or ``BLOCK_GRAMS`` n-grams (or one longer document), and only links leave it.
    """
    ship(rows.sparkSession)
    firsts = rows.groupBy("doc").agg(F.sort_array(F.collect_list("t")).alias("lists"))
    rows = rows.join(firsts, "doc").join(known.select("doc", "set"), "doc")
    count = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int")
    rows = rows.select("t", "doc", "of", "set", F.filter("lists", lambda x: x < F.col("t")).alias("before"), F.pmod(F.xxhash64("doc"), count).cast("int").alias("block"), F.sequence(F.lit(0), count - 1).alias("blocks"))
    rows = rows.select("*", F.explode("blocks").alias("other")).select("t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "of", "set", "before")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, of, block = (pdf[c].to_numpy() for c in ("doc", "of", "block"))
        size = np.array([len(x) for x in pdf["set"]])
        open_ = (of[:, None] != of[None, :]) & (np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * percent) & (doc[:, None] < doc[None, :])
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            open_ &= block[:, None] != block[None, :]
        open_ &= overlaps(pdf["before"]) == 0
        used = np.flatnonzero(open_.any(0) | open_.any(1))
        if not len(used):
            return pd.DataFrame({"a": np.array([], "int64"), "b": np.array([], "int64")})
        shared = overlaps(pdf["set"].iloc[used])
        n = size[used]
        found = open_[np.ix_(used, used)] & (shared * 100 >= (n[:, None] + n[None, :] - shared) * percent)
        x, y = np.nonzero(found)
        return pd.DataFrame({"a": doc[used][x], "b": doc[used][y]})

    return rows.groupBy("t", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def overlaps(sets: pd.Series) -> np.ndarray:
    """How many elements each two sets share, from those that are in two or more, a stretch of them at a time."""
    out = np.zeros((len(sets), len(sets)), "float32")
    lengths = [len(x) for x in sets]
    if not sum(lengths):
        return out
    values = np.concatenate([np.asarray(x, "int64") for x in sets])
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    row = np.repeat(np.arange(len(sets)), lengths)[keep]
    code = np.unique(code[keep], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        lo, hi = np.searchsorted(code, [start, start + 2048])
        part = np.zeros((len(sets), 2048), "float32")
        part[row[lo:hi], code[lo:hi] - start] = 1
        out += part @ part.T
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) for every row: groups of documents linked by a Jaccard similarity of at least ``percent``."""
    mark = written()
    share = min(1.0, LOW * (1 - percent / 100))
    low = -(1 << 63) + int(share * (1 << 64)) if share < 1 else (1 << 63) - 1
    made = sets(docs, key, text, size)
    digest = F.struct(F.xxhash64("set").alias("x"), F.xxhash64("set", F.lit(1)).alias("y"), F.size("set").alias("n"))
    lows = materialize(made.select("doc", F.size("set").alias("n"), digest.alias("sig"), F.filter("set", lambda h: h < low).alias("low")), "jaccard-low")
    signed = materialize(lows.select("doc", "n", "sig"), "jaccard-signed")

    known = signed.filter("n > 0 AND doc IS NOT NULL")
    first = materialize(known.groupBy("sig").agg(F.min("doc").alias("rep"), F.count("*").alias("m")), "jaccard-copies")
    copied = attach(known.select("doc", "sig"), first.filter("m > 1"), "sig", "m", "jaccard-copied")
    copies = materialize(copied.filter("doc <> rep").select("doc", "sig", "rep"), "jaccard-dropped")
    # An id with several texts is one node: its texts' representatives are linked by it.
    several = known.select("doc", "sig").distinct().groupBy("doc").agg(F.count("*").alias("k")).filter("k > 1").select("doc")
    shared_ids = copies.join(materialize(several, "jaccard-several"), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
    single = lows.filter("n > 0 AND doc IS NOT NULL").join(bounded_broadcast(copies.select("doc", "sig")), ["doc", "sig"], "left_anti").drop("sig")

    tokens = single.select("doc", F.explode("low").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(often, "t").groupBy("doc").agg(F.collect_list(F.struct((F.col("df") > FREQUENT).alias("hot"), "t")).alias("shared"))
    p = prefix_size(F.col("n"), percent)
    left = single.select("doc", "n", F.size("low").alias("n_low")).join(shared, "doc", "left")
    left = left.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<hot:boolean,t:bigint>>")))
    left = left.select("doc", "shared", (p - (F.col("n_low") - F.size("shared"))).alias("need")).filter("need > 0")
    left = materialize(left, "jaccard-left")
    discard(lows)

    # The whole sets are made again from the texts, for the documents that are left only.
    ids = left.select("doc").distinct()
    again = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).join(bounded_broadcast(ids), "doc", "left_semi")
    whole = filter_after(sets(again, "doc", "text", size), F.size("set") > 0).withColumn("n", F.size("set"))
    whole = materialize(whole.select("doc", "n", "set", _prefix(F.col("set"), 2, p).alias("second"), _prefix(F.col("set"), 3, p).alias("third")), "jaccard-sets")
    calm = F.transform(F.filter("shared", lambda x: ~x["hot"]), lambda x: x["t"])
    busy = F.transform(F.filter("shared", lambda x: x["hot"]), lambda x: x["t"])
    order = F.concat(F.sort_array(calm), F.filter("set", lambda h: h >= low), F.sort_array(busy))
    ordered = whole.join(left, "doc").select("doc", "n", "need", order.alias("order"))
    listed = materialize(_lists(ordered), "jaccard-prefix")

    links = listed.select("doc").limit(0).select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    marked = listed.withColumn("of", F.col("doc"))
    for seeds in PIVOTS:
        links = materialize(links.unionByName(_verify(_to_pivots(marked, seeds, percent), whole, percent)).distinct(), "jaccard-links")
        marked = materialize(_open(listed, links), "jaccard-open")
    more = materialize(_across(marked, whole, percent), "jaccard-more")
    grouped = components(links.unionByName(more).unionByName(shared_ids)).withColumnRenamed("id", "rep")
    grouped = materialize(grouped, "jaccard-components")
    linked = first.join(grouped, "rep", "left")
    linked = materialize(linked.select("sig", "m", F.coalesce("component", "rep").alias("component")), "jaccard-linked")
    tidy(mark, signed, linked)

    out = attach(known.select("doc", "n", "sig"), linked, "sig", "m", "jaccard-out").select("doc", "n", "component")
    blank = signed.filter("n = 0 AND doc IS NOT NULL")
    other = known.join(bounded_broadcast(blank.select("doc")), "doc", "left_semi").join(linked, "sig").groupBy("doc").agg(F.min("component").alias("component"))
    blank = blank.join(other, "doc", "left")
    out = out.unionByName(blank.select("doc", "n", F.coalesce("component", "doc").alias("component")))
    out = out.unionByName(signed.filter("doc IS NULL").select("doc", "n", F.col("doc").alias("component")))
    return out.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id; rows with a null id stay.

    Where ids are repeated, rows are told apart by numbers of their own, so that no text goes without one like it that stays.
    """
    mark = written()
    columns = [f"`{c}`" for c in docs.columns]
    own = F.col(f"`{key}`")
    again = docs.filter(own.isNotNull()).groupBy(own.alias("doc")).count().filter("count > 1").limit(1).count()
    if not again:
        found = groups(docs, key, text, size, percent)
        gone = materialize(found.filter(own != F.col("component_id")).select(own.alias("_gone")), "jaccard-gone")
        tidy(mark, gone)
        return docs.join(bounded_broadcast(gone), docs[f"`{key}`"] == gone["_gone"], "left_anti").select(*columns)
    number = free_name(docs, "_number")
    numbered = materialize(docs.select("*", F.monotonically_increasing_id().alias(number)), "jaccard-numbered")
    found = groups(numbered.filter(own.isNotNull()).select(number, own.alias("own"), F.col(f"`{text}`").alias("text")), number, "text", size, percent)
    ids = numbered.select(number, own.alias("own"))
    least = found.join(ids, number).groupBy("component_id").agg(F.min(F.struct("own", number)).alias("kept"))
    least = least.select(f"kept.{number}")
    # Blank texts, which are linked to none, are one document an id.
    blank = found.filter("n_shingles = 0").join(ids, number).groupBy("own").agg(F.min(number).alias(number)).select(number)
    least = materialize(least.join(found.filter("n_shingles > 0").select(number), number, "left_semi").unionByName(blank), "jaccard-kept")
    tidy(mark, numbered, least)
    kept = numbered.filter(own.isNotNull()).join(bounded_broadcast(least), number, "left_semi")
    return kept.unionByName(numbered.filter(own.isNull())).select(*columns)
