"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors by the median of their projections on a random direction, again and again; vectors near the
border go to both sides (spill overlap), by a margin that suits the distance of linked vectors. The upper splits are fitted on
a bounded sample (``SAMPLE`` vectors, taken by hash, and ``SAMPLE_BYTES``) and every vector is put into its leaves of all trees.
Leaves that hold more than ``HEAVY`` vectors then are split further, level by level, by directions drawn from the leaf's number
and medians over all their rows, so leaves don't grow with the table; only (leaf, id, projection) is shuffled for it.
Vectors are compared by cosine in double precision within leaves, in blocks of about ``BLOCK`` against blocks, so a task's
memory is bounded also where a leaf can't be split (a dense group). A pair that shares several leaves counts in the first of
them only, so a block gives no pairs but, per vector, the number of its new links and the smallest vector linked to it in the
block; those edges are united into components.

Equal vectors are one row beforehand (by a 128-bit digest of their values) and count as so many links.

Defined results: null or empty vectors, zero vectors and vectors with null or non-finite components link with nothing and
are components of their own; vectors of different lengths don't link. Repeated rows (same id, same vector) are one vector;
rows that share an id and differ are different vectors, which may link, but one node of the components. A null id links with
nothing and has a null component. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphkiln.functions.ship import ship
from graphkiln.llm.common import attach, bounded_broadcast, discard, materialize, tidy, written
from graphkiln.llm.components import components
from graphkiln.llm.jaccard import overlaps

TREES = 4
SAMPLE, SAMPLE_BYTES = 20_000, 256 << 20
#: Sampled vectors in a leaf at least, so that a split is more than chance.
LEAST = 16
LEAF, BLOCK, HEAVY = 1024, 1024, 4096
#: A split is kept if neither side holds more than this share of the vectors.
SPLIT = 0.95
#: The spill margin, in standard deviations of the projected difference of two vectors at the threshold.
MARGIN = 0.75
SEED = 11


class Forest:
    """Split nodes as (direction, border, left, right); a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf: int, cosine: float, trees: int = TREES, seed: int = SEED):
        self.random = np.random.default_rng(seed)
        self.margin = MARGIN * np.sqrt((2 - 2 * cosine) / sample.shape[1])
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.leaves = 0
        self.roots = [self._grow(sample, leaf) for _ in range(trees)]

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        if len(x) <= leaf:
            return self._leaf()
        direction = self.random.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        along = x @ direction
        border = float(np.median(along))
        left, right = along < border + self.margin, along >= border - self.margin
        if max(left.sum(), right.sum()) > SPLIT * len(x):
            return self._leaf()
        self.nodes.append((direction, border, 0, 0))
        at = len(self.nodes) - 1
        self.nodes[at] = (direction, border, self._grow(x[left], leaf), self._grow(x[right], leaf))
        return at

    def place(self, x: np.ndarray) -> list[list[int]]:
        """The leaves of each unit vector."""
        found: list[list[int]] = [[] for _ in range(len(x))]
        todo = [(root, np.arange(len(x))) for root in self.roots]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                for r in rows:
                    found[r].append(-1 - node)
                continue
            direction, border, left, right = self.nodes[node]
            along = x[rows] @ direction
            todo += [(left, rows[along < border + self.margin]), (right, rows[along >= border - self.margin])]
        return [sorted(f) for f in found]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, "float64") for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its component under the symmetric matrix ``linked``."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(leaf_rows: DataFrame, cosine: float) -> DataFrame:
    """(id, n, root) of the links within two blocks of a leaf. leaf_rows: leaf, i, j, block, id, copies, vector, before."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        linked = np.clip(_unit(_matrix(pdf["vector"])) @ _unit(_matrix(pdf["vector"])).T, -1, 1) >= cosine
        np.fill_diagonal(linked, False)
        block = pdf["block"].to_numpy()
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            linked &= block[:, None] != block[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        linked = linked[np.ix_(some, some)]
        linked &= overlaps(pdf["before"].iloc[some]) == 0
        ids = pdf["id"].to_numpy()[some]
        n = linked @ pdf["copies"].to_numpy()[some] if len(some) else np.zeros(0, "int64")
        out = pd.DataFrame({"id": ids, "n": n.astype("int64"), "root": ids[local_roots(linked)] if len(some) else ids})
        return out[out["n"] > 0]

    return leaf_rows.groupBy("leaf", "i", "j").applyInPandas(compare, "id bigint, n bigint, root bigint")


def _project(leaves: DataFrame) -> DataFrame:
    """(leaf, id, along): projections on directions drawn from the leaves' numbers. leaves: leaf, id, vector."""

    def along(batches):
        for pdf in batches:
            for leaf, part in pdf.groupby("leaf"):
                direction = np.random.default_rng((SEED, leaf & ((1 << 63) - 1))).standard_normal(len(part["vector"].iat[0]))
                yield pd.DataFrame({"leaf": leaf, "id": part["id"], "along": _unit(_matrix(part["vector"])) @ (direction / np.linalg.norm(direction))})

    return leaves.select("leaf", "id", "vector").mapInPandas(along, "leaf bigint, id bigint, along double")


def _refine(placed: DataFrame, margin: float) -> DataFrame:
    """``placed`` (id, copies, vector, leaves) with heavy leaves split until none is heavy that can be split."""
    whole = materialize(placed.select(F.lit(0).cast("long").alias("leaf")).limit(0), "forest-whole")
    while True:
        sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().filter(F.col("count") > HEAVY)
        heavy = materialize(sizes.select("leaf").join(whole, "leaf", "left_anti"), "forest-heavy")
        if not heavy.limit(1).count():
            return placed
        rows = placed.select("id", "vector", F.explode("leaves").alias("leaf")).join(bounded_broadcast(heavy), "leaf")
        rows = materialize(_project(rows), "forest-along")
        borders = rows.groupBy("leaf").agg(F.percentile_approx("along", 0.5, 1000).alias("border"))
        rows = rows.join(bounded_broadcast(materialize(borders, "forest-borders")), "leaf")
        rows = rows.select("leaf", "id", (F.col("along") < F.col("border") + margin).alias("left"), (F.col("along") >= F.col("border") - margin).alias("right"))
        rows = materialize(rows, "forest-sides")
        most = F.greatest(F.count_if("left"), F.count_if("right")) > SPLIT * F.count("*")
        known = rows.groupBy("leaf").agg(most.alias("whole"))
        known = materialize(known, "forest-known")
        whole = materialize(whole.unionByName(known.filter("whole").select("leaf")), "forest-whole")
        child = lambda side, k: F.when(F.col(side), F.xxhash64("leaf", F.lit(k)))
        split = rows.join(bounded_broadcast(known.filter("NOT whole").select("leaf")), "leaf")
        split = split.groupBy("id").agg(F.collect_list("leaf").alias("gone"), F.flatten(F.collect_list(F.array_compact(F.array(child("left", 1), child("right", 2))))).alias("come"))
        old, placed = placed, placed.join(split, "id", "left")
        leaves = F.when(F.col("gone").isNull(), F.col("leaves")).otherwise(F.sort_array(F.concat(F.array_except("leaves", "gone"), "come")))
        placed = materialize(placed.select("id", "copies", "vector", leaves.alias("leaves")), "forest-placed")
        discard(old)


def _search(singles: DataFrame, rows: int, cosine: float, kind: str, size: int) -> DataFrame:
    """(id, n, root) for vectors of ``size`` components. singles: id, copies, vector (of ``kind``)."""
    spark = singles.sparkSession
    most = max(LEAST, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    share = min(1.0, most / rows)
    taken = singles.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "vector").limit(2 * most)
    sample = _unit(_matrix(taken.toPandas().sort_values("id")["vector"])) if rows > LEAF else np.zeros((0, size))
    forest = Forest(sample, max(LEAST, round(LEAF * share)), cosine)
    shipped = spark.sparkContext.broadcast(forest)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaves=shipped.value.place(_unit(_matrix(pdf["vector"]))))

    placed = singles.mapInPandas(place, f"id bigint, copies bigint, vector {kind}, leaves array<bigint>")
    placed = _refine(materialize(placed, "forest-placed"), forest.margin)
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    sizes = materialize(sizes.select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "forest-leaves")
    spread = placed.select("id", "copies", "vector", "leaves", F.explode("leaves").alias("leaf")).join(bounded_broadcast(sizes), "leaf")
    spread = spread.select("leaf", "id", "copies", "vector", F.filter("leaves", lambda x: x < F.col("leaf")).alias("before"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "vector", "before")
    return _compare(spread, cosine)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links of at least ``cosine``."""
    ship(vectors.sparkSession)
    mark = written()
    small = isinstance(getattr(vectors.schema[vector].dataType, "elementType", None), (T.FloatType, T.ByteType, T.ShortType))
    kind = "array<float>" if small else "array<double>"
    v = F.col(f"`{vector}`").cast(kind)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("own"), F.when(usable(v), v).alias("vector"))
    digest = F.when(F.col("vector").isNotNull() & F.col("own").isNotNull(), F.struct(F.xxhash64("vector").alias("x"), F.xxhash64("vector", F.lit(1)).alias("y"), F.size("vector").alias("d")))
    rows = materialize(rows.withColumn("digest", digest), "forest-vectors")
    known = rows.filter(F.col("digest").isNotNull()).select("own", "digest")
    pairs = materialize(known.distinct(), "forest-pairs")
    first = pairs.groupBy("digest").agg(F.min("own").alias("own"), F.count("*").alias("copies"))
    nodes = materialize(first.withColumn("id", F.monotonically_increasing_id()), "forest-nodes")
    singles = nodes.join(rows.filter(F.col("digest").isNotNull()), ["digest", "own"]).dropDuplicates(["digest"])
    singles = materialize(singles.select("id", "copies", "vector"), "forest-singles")
    lengths = singles.groupBy(F.size("vector").alias("d")).count().collect()  # one row a length
    found = vectors.sparkSession.range(0).select("id", F.col("id").alias("n"), F.col("id").alias("root"))
    for row in sorted(lengths, key=lambda r: r["d"]):
        part = materialize(_search(singles.filter(F.size("vector") == row["d"]), row["count"], cosine, kind, row["d"]), "forest-links")
        found = found.unionByName(part)
    # Vectors that share an id are one node of the components.
    several = materialize(pairs.groupBy("own").agg(F.count("*").alias("k")).filter("k > 1").select("own"), "forest-several")
    shared = pairs.join(bounded_broadcast(several), "own", "left_semi").join(nodes.select("digest", "id"), "digest")
    shared = shared.join(shared.groupBy("own").agg(F.min("id").alias("root")), "own")
    grouped = components(found.select("id", "root").unionByName(shared.select("id", "root")), "id", "root")
    grouped = nodes.join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    grouped = materialize(grouped.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left"), "forest-grouped")
    least = materialize(grouped.groupBy("component").agg(F.min("own").alias("component_id"), F.count("*").alias("m")), "forest-least")
    named = attach(grouped, least, "component", "m", "forest-named")
    named = materialize(named.select("digest", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "forest-named")

    good = attach(rows.filter(F.col("digest").isNotNull()).select("own", "digest"), named, "digest", "copies", "forest-rows").select("own", "n_links", "component_id")
    bad = rows.filter(F.col("digest").isNull() & F.col("own").isNotNull()).select("own")
    other = pairs.join(bad, "own", "left_semi").join(named.select("digest", "component_id"), "digest").groupBy("own").agg(F.min("component_id").alias("component_id"))
    bad = bad.join(other, "own", "left").select("own", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
    null = rows.filter(F.col("own").isNull()).select("own", F.lit(0).cast("long").alias("n_links"), F.col("own").alias("component_id"))
    out = good.unionByName(bad).unionByName(null)
    tidy(mark, rows, pairs, named)
    return out.select(F.col("own").alias(key), "n_links", "component_id", F.coalesce(F.col("own") == F.col("component_id"), F.lit(True)).alias("kept"))
