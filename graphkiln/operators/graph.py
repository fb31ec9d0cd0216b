"""Relational operators on property graphs: nodes (id, ...), edges (id, type, source, target, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions.cut import cut


def remap_endpoints(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Both ends replaced by their canonical ids (remap: node_id, canonical_id); unmapped ends stay."""
    for end in ("source", "target"):
        side = remap.select(F.col("node_id").alias(end), F.col("canonical_id").alias("_to"))
        edges = edges.join(side, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def flatten_map(remap: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Every chain followed to its root by pointer doubling; a cycle stops where it began."""
    flat = remap.filter("node_id <> canonical_id")
    for _ in range(max_rounds):
        nxt = flat.select(F.col("node_id").alias("canonical_id"), F.col("canonical_id").alias("_next"))
        joined = flat.join(nxt, "canonical_id", "left")
        moved = joined.select("node_id", F.when(F.col("_next") == F.col("node_id"), F.col("canonical_id")).otherwise(F.coalesce("_next", "canonical_id")).alias("canonical_id"), (F.col("_next").isNotNull() & (F.col("_next") != F.col("node_id"))).alias("_moved"))
        moved = cut(moved)
        flat = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            break
    return flat


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """No empty ends, no self-loops, both ends among the nodes."""
    ids = nodes.select("id").distinct()
    ok = edges.filter((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "") & (F.col("source") != F.col("target")))
    return ok.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def edge_audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per type: edges, self-loops, dangling, valid."""
    ids = nodes.select("id").distinct()
    marked = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    loop = F.col("source") == F.col("target")
    dangling = ~loop & (F.col("_s").isNull() | F.col("_t").isNull())
    return marked.groupBy("type").agg(F.count("*").alias("n_edges"), F.count_if(loop).alias("n_loops"), F.count_if(dangling).alias("n_dangling"), F.count_if(~loop & ~dangling).alias("n_valid"))


def dedupe_edges(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """One edge per (source, target, type): the first id, all merged ids in order, and their number."""
    first = F.col("id") if order is None else order
    grouped = edges.groupBy("source", "target", "type").agg(F.min_by("id", first).alias("id"), F.array_sort(F.collect_list("id")).alias("merged_from_ids"), F.count("*").alias("merge_count"))
    return grouped.withColumn("merged_from_ids", F.when(F.col("merge_count") > 1, F.col("merged_from_ids")))


def canonicalize_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    return dedupe_edges(remap_endpoints(edges, remap).filter("source <> target"))


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, uses): ends of edges that are not nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("uses")).join(nodes.select("id"), "id", "left_anti")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, type, target, created_count) of edges whose ends exist."""
    ids = nodes.select("id").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return ok.groupBy("source", "type", "target").agg(F.count("*").alias("created_count"))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest row of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank", "_new")


def edge_pattern(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, source_name, type, target, target_name); names fall back to ids."""
    side = lambda end: nodes.select(F.col("id").alias(end), F.coalesce("name", "id").alias(f"{end}_name"))
    return edges.join(side("source"), "source").join(side("target"), "target").select("source", "source_name", "type", "target", "target_name")


def neighbors(edges: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """(id, type, other): up to ``limit`` distinct neighbours of each id in either direction, by type and id."""
    out = edges.select(F.col("source").alias("id"), "type", F.col("target").alias("other"))
    both = out.unionByName(edges.select(F.col("target").alias("id"), "type", F.col("source").alias("other"))).join(ids, "id", "left_semi").distinct()
    rank = Window.partitionBy("id").orderBy("type", "other")
    return both.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)


def entity_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, n_out, n_in, out_types, in_types), each direction aggregated before it is joined."""
    def side(end: str, tag: str) -> DataFrame:
        distinct = edges.groupBy(F.col(end).alias("id"), "type", "source", "target").agg(F.count("*").alias("_n"))
        return distinct.groupBy("id").agg(F.count("*").alias(f"n_{tag}"), F.array_sort(F.collect_set("type")).alias(f"{tag}_types"))

    none = F.array().cast("array<string>")
    joined = nodes.join(side("source", "out"), "id", "left").join(side("target", "in"), "id", "left")
    return joined.select("id", "name", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("out_types", none).alias("out_types"), F.coalesce("in_types", none).alias("in_types"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_subgraph(nodes: DataFrame, edges: DataFrame, n_nodes: int, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree and the edges among them."""
    ranked = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = ranked.orderBy(F.desc("degree"), "id").limit(n_nodes).select("id", "degree")
    kept = edges.join(top.select(F.col("id").alias("source")), "source", "left_semi").join(top.select(F.col("id").alias("target")), "target", "left_semi")
    return top, kept.orderBy("id").limit(n_edges)


def edges_by_type(edges: DataFrame, types: int = 5, shown: int = 3) -> DataFrame:
    """(source, type, targets, n): for each source its first types with a few targets and '(+n more)'."""
    grouped = edges.select("source", "type", "target").distinct().groupBy("source", "type").agg(F.array_sort(F.collect_list("target")).alias("all"))
    ranked = grouped.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("type"))).filter(F.col("_r") <= types)
    more = F.when(F.size("all") > shown, F.concat(F.lit(" (+"), (F.size("all") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return ranked.select("source", "type", F.concat(F.array_join(F.slice("all", 1, shown), ", "), more).alias("targets"), F.size("all").alias("n"))


def merge_entities(nodes: DataFrame, edges: DataFrame, canonical: str, duplicates: list[str]) -> tuple[DataFrame, DataFrame]:
    """Duplicates merged into an existing canonical node: labels united in order, blanks filled, edges moved, loops dropped.

    nodes: id, labels, name, aliases, pos. Duplicates that don't exist are skipped; a missing canonical node raises.
    """
    if not nodes.filter(F.col("id") == canonical).limit(1).count():
        raise ValueError(f"no such entity: {canonical}")
    rank = F.when(F.col("id") == canonical, -1)
    for k, d in enumerate(duplicates):
        rank = rank.when(F.col("id") == d, k)
    group = nodes.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_rank", c))), lambda x: x[c])
    merged = group.agg(
        F.lit(canonical).alias("id"),
        F.filter(F.array_distinct(F.flatten(order("labels"))), lambda x: x != "KgNode").alias("labels"),
        F.get(F.filter(order("name"), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)).alias("name"),
        F.array_distinct(F.flatten(order("aliases"))).alias("aliases"),
        F.min("pos").alias("pos"),
    )
    rest = nodes.filter(~F.col("id").isin([canonical, *duplicates]))
    remap = nodes.filter(F.col("id").isin(duplicates) & (F.col("id") != canonical)).select(F.col("id").alias("node_id"), F.lit(canonical).alias("canonical_id"))
    return rest.unionByName(merged.select(*rest.columns)), canonicalize_edges(edges, remap)


def bfs(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth): what is reached from ``start`` (id) along edges, level by level; visited ids are anti-joined."""
    links = edges.select(F.col("source").alias("id"), "target").distinct()
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        frontier = links.join(frontier.select("id"), "id", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = cut(frontier.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen
