"""Vectors: hash embeddings, cosine, nearest neighbours, threshold pairs within blocks, components, cluster numbers, metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions.cut import cut
from graphkiln.functions.ship import ship


#: Rows of a tile's side.
TILE = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if either vector is zero."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """(key, vector): signed, weighted token hashes added up by position, then scaled to length 1; zeros without tokens."""
    words = df.select(key, F.explode(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), "")).alias("w"))
    h = F.sha2(F.col("w").cast("binary"), 256)
    part = lambda start, size: F.conv(F.substring(h, start, size), 16, 10).cast("long")
    sign = F.when(part(9, 2) % 2 == 0, 1.0).otherwise(-1.0)
    cells = words.select(key, (part(1, 8) % dim).cast("int").alias("i"), (sign * (1.0 + part(11, 2) / 255.0)).alias("x"))
    cells = cells.groupBy(key, "i").agg(F.sum("x").alias("x"))
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    cell = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
    made = rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("size") > 0, cell(i) / F.col("size")).otherwise(0.0)).alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return df.select(key).join(made, key, "left").select(key, F.coalesce("vector", zeros).alias("vector"))


def _tiles(left: DataFrame, right: DataFrame, found) -> DataFrame:
    """(block, a, b, score) from ``found(scores)`` over tiles of at most about ``TILE`` x ``TILE`` rows. left, right: block, id, v.

    A block of any size is cut into tiles by hashes of its ids, so a task holds two stretches of rows, multiplies them as matrices and
    gives off only what ``found(scores, a, b)``, a boolean matrix, keeps. Rows without a usable vector are left out.
    """
    ship(left.sparkSession)
    parts = lambda df, n: df.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias(n))
    counts = cut(parts(left, "n").join(parts(right, "m"), "block"))

    def spread(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        rows = df.join(counts, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("own", "other") if side == "a" else ("other", "own")
        return rows.select("block", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "v")

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, "float64") for v in vectors])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf[pdf["side"] == s].sort_values("id", ignore_index=True) for s in "ab")
        if not len(one) or not len(two):
            return pd.DataFrame({"block": pdf["block"].iloc[:0], "a": pdf["id"].iloc[:0], "b": pdf["id"].iloc[:0], "score": np.zeros(0)})
        scores = np.clip(unit(one["v"]) @ unit(two["v"]).T, -1, 1).round(14)
        x, y = np.nonzero(found(scores, one["id"].to_numpy(), two["id"].to_numpy()))
        return pd.DataFrame({"block": pdf["block"].iat[0], "a": one["id"].to_numpy()[x], "b": two["id"].to_numpy()[y], "score": scores[x, y]})

    kinds = dict(left.dtypes)
    both = spread(left, "a", "n", "m").unionByName(spread(right, "b", "m", "n"))
    return both.groupBy("block", "i", "j").applyInPandas(compare, f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}, score double")


def _usable(df: DataFrame, block: Column, key: str, vector: str) -> DataFrame:
    rows = df.select(block.alias("block"), F.col(key).alias("id"), F.col(vector).alias("v"))
    return rows.filter(F.col("block").isNotNull() & F.col("v").isNotNull() & (norm(F.col("v")) > 0))


def threshold_pairs(df: DataFrame, key: str, vector: str, block: str, threshold: float) -> DataFrame:
    """(block, a, b, sim) of pairs a < b within a block with cosine >= threshold."""
    rows = _usable(df, F.col(block), key, vector)
    return _tiles(rows, rows, lambda scores, a, b: (scores >= threshold) & (a[:, None] < b[None, :])).withColumnRenamed("score", "sim")


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, least: float | None = None, skip_self: bool = False) -> DataFrame:
    """(query, id, score, rank): the k most similar rows of ``base`` for each query; ties by id. Each tile gives k rows a query at most."""

    def best(scores: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = scores >= (least if least is not None else -2)
        if skip_self:
            ok &= a[:, None] != b[None, :]
        order = np.argsort(np.where(ok, -scores, np.inf), axis=1, kind="stable")[:, :k]  # columns are in order of ids
        chosen = np.zeros_like(ok)
        np.put_along_axis(chosen, order, True, axis=1)
        return chosen & ok

    whole = F.lit(0)
    found = _tiles(_usable(queries, whole, key, vector), _usable(base, whole, key, vector), best)
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.select(F.col("a").alias("query"), F.col("b").alias("id"), "score")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def components(pairs: DataFrame, nodes: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root): min-label propagation with pointer jumping over pairs (a, b); lineage is cut every round."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = cut(both)
    labels = nodes.select("id", F.col("id").alias("root"))
    labels = cut(labels)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("root").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(jump, "root").select("id", "old", F.least("root", "far").alias("root")))
        labels = step.select("id", "root")
        if not step.filter("old <> root").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def number_clusters(labelled: DataFrame) -> DataFrame:
    """(id, block, cluster_id, probability): components of two and more numbered by first id in their block; others are noise.

    labelled: id, block, root.
    """
    sizes = labelled.groupBy("block", "root").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    order = Window.partitionBy("block").orderBy("first")
    numbered = sizes.filter("size > 1").withColumn("no", F.row_number().over(order) - 1)
    joined = labelled.join(numbered.select("block", "root", "no"), ["block", "root"], "left")
    name = F.concat(F.lower(F.col("block").cast("string")), F.lit("_"), F.lpad(F.col("no").cast("string"), 4, "0"))
    return joined.select("id", "block", F.coalesce(name, F.lit("noise")).alias("cluster_id"), F.when(F.col("no").isNull(), 0.0).otherwise(0.9).alias("probability"))


def cluster_metrics(assigned: DataFrame) -> DataFrame:
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))
    real = F.col("cluster_id") != "noise"
    return sizes.agg(F.count_if(real).alias("num_clusters"), F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)).alias("num_noise"), F.max(F.when(real, F.col("size"))).alias("max_size"), F.min(F.when(real, F.col("size"))).alias("min_size"), F.avg(F.when(real, F.col("size"))).alias("avg_size"))


def intra_similarity(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(cluster, n, similarity): the mean cosine of a cluster's pairs from the sum of its unit vectors; 1 for fewer than two.

    Linear in the cluster's size: |sum u|^2 = n + 2 * (sum of pair cosines).
    """
    unit = df.select(F.col(cluster).alias("cluster"), F.col(key).alias("id"), F.posexplode(vector).alias("i", "x"), norm(F.col(vector)).alias("size"))
    sums = unit.filter("size > 0").groupBy("cluster", "i").agg(F.sum(F.col("x").cast("double") / F.col("size")).alias("s"))
    squares = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    n = F.col("n")
    return counts.join(squares, "cluster", "left").select("cluster", "n", F.when(n < 2, 1.0).otherwise((F.col("q") - n) / (n * (n - 1))).alias("similarity"))
