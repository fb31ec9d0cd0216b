"""Entity resolution: merging records, choosing names, conservative groups, complete partitions, unique ids, incremental updates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphkiln.functions import text as t
from graphkiln.functions.cut import cut
from graphkiln.functions.ship import ship

#: Weights of the canonical name's score.
PER_USE, PREFERRED, FIT_MOST, BEST_LENGTH = 2.0, 1.5, 3.0, 35
#: Words that make a name a sentence.
SENTENCE = r"(?iU)\b(là|thuộc|được|refers|same|under|located|based)\b"


#: Fixed value: about how many rows stand on each side when pairs are listed.
SIDE = 512


def jaccard_pairs(items: DataFrame, least: float) -> DataFrame:
    """(block, a, b, jaccard): the pairs of keys a < b of a block whose sets of words have at least this Jaccard index, which is rounded to 6 places.

    items: block, key, words (distinct). A word that only one of a block's different sets has is in no intersection. So sets with the
    same shared words and the same size are one class, classes are compared, and the rows of the classes found are listed in pairs of
    stretches, each dealt out on its own. Rows with the same set have an index of 1. Null blocks, keys and words are left out.
    """
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select("block", "key", F.sort_array("words").alias("words")).dropna()
    sets = rows.select("block", "words").distinct()
    word = sets.select("block", "words", F.explode_outer("words").alias("word"))
    shared = word.groupBy("block", "word").agg(F.count("*").alias("n")).filter("n > 1").select("block", "word", F.lit(True).alias("common"))
    split = word.join(shared.hint("merge"), ["block", "word"], "left").groupBy("block", "words")
    kinds = split.agg(F.sort_array(F.collect_list(F.when(F.col("common"), F.col("word")))).alias("common")).select("block", "words", F.struct("common", F.size("words").alias("size")).alias("kind"))
    members = cut(rows.join(kinds.hint("merge"), ["block", "words"]).select("block", "kind", F.struct("key", F.array_except("words", "kind.common").alias("own")).alias("x")))

    def share(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a["common"], b["common"]))
        return both / (a["size"] + b["size"] - both).cast("double")

    classes = members.groupBy("block", "kind").agg(F.count("*").alias("n"))
    left, right = classes.select("block", F.col("kind").alias("k"), F.col("n").alias("nk")), classes.select("block", F.col("kind").alias("l"), F.col("n").alias("nl"))
    found = left.join(right, "block").filter("k <= l").withColumn("share", share(F.col("k"), F.col("l"))).filter(F.col("share") >= least)
    found = found.select("block", "k", "l", "nk", "nl", F.round("share", 6).alias("share"))
    near = _listed(members, found, parts)
    # The others of a class aren't near; the copies of a set in it are.
    apart = members.filter(share(F.col("kind"), F.col("kind")) < least).select("block", F.struct("kind", "x.own").alias("kind"), "x")
    copies = apart.groupBy("block", F.col("kind").alias("k")).agg(F.count("*").alias("nk")).filter("nk > 1")
    copies = copies.select("block", "k", F.col("k").alias("l"), "nk", F.col("nk").alias("nl"), F.lit(1.0).alias("share"))
    return near.unionByName(_listed(apart, copies, parts))


def _listed(members: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The pairs of the rows of kinds k <= l. members: block, kind, x (key, own); found: block, k, l, their numbers of rows nk and nl, share."""
    pieces = lambda n: F.ceil(F.col(n) / SIDE).cast("long")
    sizes = found.select("block", F.col("k").alias("kind"), F.col("nk").alias("n")).unionByName(found.select("block", F.col("l").alias("kind"), F.col("nl").alias("n"))).distinct()
    piece = F.pmod(F.xxhash64("x.key"), pieces("n"))
    stretches = members.join(sizes, ["block", "kind"]).groupBy("block", "kind", piece.alias("piece")).agg(F.collect_list("x").alias("xs"))
    side = lambda k, i, xs: stretches.select("block", F.col("kind").alias(k), F.col("piece").alias(i), F.col("xs").alias(xs)).hint("merge")
    each = found.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), pieces("nk") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), pieces("nl") - 1)))
    each = each.filter("k < l OR i <= j").join(side("k", "i", "xs"), ["block", "k", "i"]).join(side("l", "j", "ys"), ["block", "l", "j"])
    each = each.select("block", F.expr("k = l").alias("same"), F.expr("k = l AND i = j").alias("own_pairs"), "share", "i", "j", "xs", "ys").repartition(parts, "block", "share", "i", "j")
    pairs = each.select("block", "same", "own_pairs", "share", "ys", F.explode("xs").alias("x")).select("block", "same", "own_pairs", "share", "x", F.explode("ys").alias("y"))
    pairs = pairs.filter("x.key < y.key OR (NOT own_pairs AND x.key > y.key)")
    jaccard = F.when(F.col("same") & (F.col("x.own") == F.col("y.own")), 1.0).otherwise(F.col("share"))
    return pairs.select("block", F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), jaccard.alias("jaccard"))


def short_penalty(name: Column, n_tokens: Column) -> Column:
    size = F.length(name)
    acronym = (n_tokens == 1) & (name == F.upper(name)) & (name != F.lower(name)) & (size <= 6)
    return F.when(size <= 3, 4.0).when(acronym, 3.0).when((n_tokens <= 2) & (size <= 8), 1.5).otherwise(0.0)


def long_penalty(name: Column, n_tokens: Column) -> Column:
    marks = F.length(F.regexp_replace(name, "[^,;:.]", ""))
    by_size = F.when(F.length(name) > 90, 3.0).when(F.length(name) > 65, 1.5).otherwise(0.0)
    by_tokens = F.when(n_tokens > 12, 2.0).when(n_tokens > 9, 1.0).otherwise(0.0)
    return by_size + by_tokens + F.when(marks >= 2, 1.0).otherwise(0.0) + F.when(name.rlike(SENTENCE), 2.0).otherwise(0.0)


def canonical_names(candidates: DataFrame, key: str = "id", name: str = "name", preferred: Column | None = None) -> DataFrame:
    """(key, name): the best name of each key's candidates, one row a use.

    Uses that differ in case are one candidate, shown in the form with the most capitals, letters and least length. A
    candidate gains from use, preference and from names that contain it or that it contains.
    """
    shown = t.collapse(t.nfkc(F.coalesce(F.col(name), F.lit(""))))
    rows = candidates.select(F.col(key).alias("key"), shown.alias("text"), (F.lit(False) if preferred is None else F.coalesce(preferred, F.lit(False))).alias("preferred")).filter("text <> ''")
    upper, letters = F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")), F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    rows = rows.select("*", t.name_key(F.col("text")).alias("form"), F.struct(upper.alias("u"), letters.alias("l"), (-F.length("text")).alias("s")).alias("look"))
    forms = rows.groupBy("key", "form").agg(F.count("*").alias("uses"), F.max_by("text", F.struct("look", "text")).alias("text"), F.max("look").alias("look"), F.bool_or("preferred").alias("preferred"))
    forms = forms.withColumn("tokens", F.array_distinct(t.name_tokens(F.col("text"))))
    other = forms.select("key", F.col("form").alias("form_2"), F.col("tokens").alias("tokens_2"))
    shared, mine, theirs = F.size(F.array_intersect("tokens", "tokens_2")), F.size("tokens"), F.size("tokens_2")
    gain = F.when((shared == mine) & (theirs > mine), 1.5).when(shared == theirs, 0.5).otherwise(shared / theirs * 0.25)
    fit = forms.join(other, "key").filter("form <> form_2 AND size(tokens) > 0 AND size(tokens_2) > 0").groupBy("key", "form").agg(F.least(F.lit(FIT_MOST), F.sum(gain)).alias("fit"))
    scored = forms.join(fit, ["key", "form"], "left")
    n = F.size("tokens")
    score = F.col("uses") * PER_USE + F.when(F.col("preferred"), PREFERRED).otherwise(0.0) + F.coalesce("fit", F.lit(0.0)) - short_penalty(F.col("text"), n) - long_penalty(F.col("text"), n)
    rank = F.struct(score, "preferred", -F.abs(F.length("text") - BEST_LENGTH), -F.length("text"), "look", "text")
    return scored.groupBy("key").agg(F.max_by("text", rank).alias("name")).withColumnRenamed("key", key)


def merge_records(records: DataFrame) -> DataFrame:
    """Records of one id in (source_file, pos) order: labels and aliases united in order, descriptions as a sorted set, first file, chosen name.

    records: id, source_file, pos, labels, name, aliases, description (arrays but name).
    """
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("source_file", "pos", F.col(c).alias("x")))), lambda x: x["x"])
    merged = records.groupBy("id").agg(
        F.min("source_file").alias("first_file"), F.array_distinct(F.flatten(order("labels"))).alias("all_labels"),
        t.aliases(F.array_distinct(F.flatten(order("aliases")))).alias("all_aliases"), F.array_sort(F.array_distinct(F.flatten(order("description")))).alias("all_description"),
        F.count("*").alias("n_records"),
    )
    uses = records.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return merged.withColumnsRenamed({"first_file": "source_file", "all_labels": "labels", "all_aliases": "aliases", "all_description": "description"}).join(canonical_names(uses), "id", "left")


def longest(values: str, order: str) -> Column:
    """An aggregate: the longest value, of equal ones the first."""
    return F.max_by(values, F.struct(F.length(values), -F.col(order)))


def conservative_groups(members: DataFrame, least: float = 0.88) -> DataFrame:
    """(cluster, node_id, seed): in order of pos, a free node takes in every free later node that is similar and shares a name.

    members: cluster, pos, node_id, names (array), vector. The greedy order makes this sequential within a cluster;
    clusters come from blocking and are small.
    """
    ship(members.sparkSession)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["pos", "node_id"], ignore_index=True)
        x = np.stack([np.asarray(v, "float64") for v in pdf["vector"]])
        size = np.linalg.norm(x, axis=1)
        unit = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
        names = [{n.lower().strip() for n in row if n and n.strip()} for row in pdf["names"]]
        seed = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            if seed[i] >= 0:
                continue
            seed[i] = i
            near = np.flatnonzero((unit[i + 1 :] @ unit[i] >= least) & (seed[i + 1 :] < 0)) + i + 1 if size[i] > 0 else ()
            for j in near:
                if any(a in b or b in a for a in names[i] for b in names[j]):
                    seed[j] = i
        return pd.DataFrame({"cluster": pdf["cluster"], "node_id": pdf["node_id"], "seed": pdf["node_id"].to_numpy()[seed]})

    kinds = dict(members.dtypes)
    return members.groupBy("cluster").applyInPandas(merge, f"cluster {kinds['cluster']}, node_id {kinds['node_id']}, seed {kinds['node_id']}")


def repair_partition(members: DataFrame, proposed: DataFrame) -> DataFrame:
    """(cluster, grp, node_id) that covers every member once: the first proposal of a member counts, unknown ids go, missing ones are alone.

    members: cluster, node_id; proposed: cluster, grp, pos, node_id.
    """
    known = proposed.join(members, ["cluster", "node_id"], "left_semi")
    first = known.groupBy("cluster", "node_id").agg(F.min(F.struct("grp", "pos"))["grp"].alias("grp"))
    alone = members.join(first, ["cluster", "node_id"], "left_anti").withColumn("grp", F.concat(F.lit("single_"), F.col("node_id").cast("string")))
    return first.select("cluster", F.col("grp").cast("string").alias("grp"), "node_id").unionByName(alone.select("cluster", "grp", "node_id"))


def unique_ids(df: DataFrame, base: str, order: str, taken: list[str] = (), max_rounds: int = 100) -> DataFrame:
    """``df`` plus ``unique_id``: the base id for its first row, then _2, _3 and so on, never one that is used or taken.

    Ranks are given by a window; rows whose suffixed id collides are moved on until none does.
    """
    rank = F.row_number().over(Window.partitionBy(base).orderBy(order))
    bases = df.select(F.col(base).alias("_id")).distinct()
    if taken:
        bases = bases.unionByName(df.sparkSession.createDataFrame([(x,) for x in taken], "_id string")).distinct()
    free = F.concat(F.col(base), F.lit("_"), F.col("_k").cast("string"))
    ranked = df.withColumn("_k", rank)
    for _ in range(max_rounds):
        named = ranked.withColumn("_id", F.when(F.col("_k") == 1, F.col(base)).otherwise(free))
        clash = named.filter("_k > 1").join(bases, "_id", "left_semi").select(base, F.col("_k").alias("_from")).groupBy(base).agg(F.min("_from").alias("_from"))
        if not clash.limit(1).count():
            return named.withColumnRenamed("_id", "unique_id").drop("_k")
        ranked = ranked.join(clash, base, "left").withColumn("_k", F.when(F.col("_k") >= F.col("_from"), F.col("_k") + 1).otherwise(F.col("_k"))).drop("_from")
    raise RuntimeError("ids did not settle")


def pair_checks(pairs: DataFrame) -> DataFrame:
    """pairs (cluster, name_sim, alias_sim, same_source) -> per cluster whether persons, units and sources hold."""
    person = (F.col("name_sim") >= 0.80) | (F.col("alias_sim") >= 0.50)
    return pairs.groupBy("cluster").agg(F.bool_and(person).alias("person_ok"), F.bool_and(F.col("name_sim") >= 0.90).alias("unit_ok"), (~F.bool_or("same_source")).alias("source_ok"))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over the summed lengths, in whole percent; 0 if either is blank."""

    def ratio(x, y):
        if not x or not y:
            return 0.0
        # A bit for each character of x: cleared where a longer common subsequence begins to end there.
        where: dict[str, int] = {}
        for k, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << k
        every = (1 << len(x)) - 1
        row = every
        for c in y:
            met = row & where.get(c, 0)
            row = ((row + met) | (row - met)) & every
        common = len(x) - row.bit_count()
        return round(100 * 2 * common / (len(x) + len(y))) / 100

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def incremental(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities after, counters): new records (id, name, match) replace what they match or are added; match null means none."""
    hit = new.join(existing.select(F.col("id").alias("match")), "match", "left_semi")
    added = new.join(existing.select(F.col("id").alias("match")), "match", "left_anti")
    kept = existing.join(hit.select(F.col("match").alias("id")).distinct(), "id", "left_anti").select("id", "name", F.lit("kept").alias("state"))
    merged = hit.groupBy(F.col("match").alias("id")).agg(F.max_by("name", "id").alias("name")).withColumn("state", F.lit("merged"))
    after = kept.unionByName(merged).unionByName(added.select("id", "name", F.lit("new").alias("state")))
    return after, after.groupBy("state").agg(F.count("*").alias("n"))
