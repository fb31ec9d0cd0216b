"""Queries over the star schema's property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.operators import graph
from graphkiln.sources import star

G = f"WITH RECURSIVE {star.NODES_SQL}, {star.EDGES_SQL}, {star.MAP_SQL}"
REMAPPED = "moved AS (SELECT e.id, e.type, coalesce(a.canonical_id, e.source) AS source, coalesce(b.canonical_id, e.target) AS target FROM edges e LEFT JOIN remap a ON a.node_id = e.source LEFT JOIN remap b ON b.node_id = e.target)"
DEDUPED = "SELECT source, target, type, min(id) AS id, CASE WHEN count(*) > 1 THEN list_sort(list(id)) END AS merged_from_ids, count(*) AS merge_count"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{G}, {REMAPPED}, ok AS (SELECT * FROM moved WHERE source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)), d AS (SELECT source, target, type, count(*) AS c FROM ok GROUP BY ALL) SELECT type, sum(c)::BIGINT AS n_edges, count(*) AS n_distinct, sum(c - 1)::BIGINT AS n_removed, max(c) AS max_merge FROM d GROUP BY type")
def resolve_and_rewire(spark, d) -> DataFrame:
    nodes = star.nodes(spark, d)
    moved = graph.remap_endpoints(star.edges(spark, d), star.canonical_map(spark, d))
    counted = graph.valid_edges(moved, nodes).groupBy("source", "target", "type").agg(F.count("*").alias("c"))
    return counted.groupBy("type").agg(F.sum("c").alias("n_edges"), F.count("*").alias("n_distinct"), F.sum(F.col("c") - 1).alias("n_removed"), F.max("c").alias("max_merge"))


@query(f"{G}, {REMAPPED} SELECT * FROM moved")
def remap_endpoints(spark, d) -> DataFrame:
    return graph.remap_endpoints(star.edges(spark, d), star.canonical_map(spark, d)).select("id", "type", "source", "target")


@query(f"{G} SELECT coalesce(m.canonical_id, n.id) AS id, count(*) AS n_members, min(n.name) AS first_name FROM nodes n LEFT JOIN remap m ON m.node_id = n.id GROUP BY 1")
def remap_nodes(spark, d) -> DataFrame:
    joined = star.nodes(spark, d).join(star.canonical_map(spark, d).withColumnRenamed("node_id", "id"), "id", "left")
    return joined.groupBy(F.coalesce("canonical_id", "id").alias("id")).agg(F.count("*").alias("n_members"), F.min("name").alias("first_name"))


@query(f"{G}, {REMAPPED} SELECT type, count(*) AS n_edges, count(*) FILTER (source = target) AS n_loops, count(*) FILTER (source <> target AND NOT (source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))) AS n_dangling, count(*) FILTER (source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)) AS n_valid FROM moved GROUP BY type")
def filter_edges(spark, d) -> DataFrame:
    return graph.edge_audit(graph.remap_endpoints(star.edges(spark, d), star.canonical_map(spark, d)), star.nodes(spark, d))


@query(f"{G} {DEDUPED} FROM edges GROUP BY source, target, type")
def dedupe_edges(spark, d) -> DataFrame:
    return graph.dedupe_edges(star.edges(spark, d)).select("source", "target", "type", "id", "merged_from_ids", "merge_count")


@query(f"{G}, {REMAPPED} {DEDUPED} FROM moved WHERE source <> target GROUP BY source, target, type")
def canonicalize_edges(spark, d) -> DataFrame:
    return graph.canonicalize_edges(star.edges(spark, d), star.canonical_map(spark, d)).select("source", "target", "type", "id", "merged_from_ids", "merge_count")


@query(f"{G}, u AS (SELECT unnest([source, target]) AS id FROM edges) SELECT id, count(*) AS uses FROM u WHERE id NOT IN (SELECT id FROM nodes) GROUP BY id")
def orphans(spark, d) -> DataFrame:
    return graph.orphans(star.edges(spark, d), star.nodes(spark, d))


@query(f"{G} SELECT type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY type")
def endpoints_exist(spark, d) -> DataFrame:
    ids = star.nodes(spark, d).select("id")
    ok = star.edges(spark, d).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return ok.groupBy("type").agg(F.count("*").alias("n"))


@query(f"{G} SELECT source, type, target, count(*) AS created_count FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY source, type, target")
def sink_edges_upsert(spark, d) -> DataFrame:
    return graph.upsert_edges(star.edges(spark, d), star.nodes(spark, d))


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def sink_nodes_upsert(spark, d) -> DataFrame:
    events = star.table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return graph.upsert_nodes(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), "user_id", "event_id")


@query(f"{G} SELECT source, s.name AS source_name, type, target, t.name AS target_name FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target")
def edge_pattern(spark, d) -> DataFrame:
    return graph.edge_pattern(star.edges(spark, d), star.nodes(spark, d))


@query(f"""{G}, e AS (SELECT DISTINCT type, source, target FROM edges),
o AS (SELECT source AS id, count(*) AS n, list_sort(list(DISTINCT type)) AS t FROM e GROUP BY 1), i AS (SELECT target AS id, count(*) AS n, list_sort(list(DISTINCT type)) AS t FROM e GROUP BY 1)
SELECT nodes.id, name, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(o.t, []) AS out_types, coalesce(i.t, []) AS in_types FROM nodes LEFT JOIN o USING (id) LEFT JOIN i ON i.id = nodes.id""")
def entity_details(spark, d) -> DataFrame:
    return graph.entity_details(star.nodes(spark, d), star.edges(spark, d))


NEAR = "near AS (SELECT source AS id, type, target AS other FROM edges UNION SELECT target, type, source FROM edges)"


@query(f"{G}, {NEAR} SELECT id, type, other, row_number() OVER (PARTITION BY id ORDER BY type, other) AS rank FROM near WHERE id IN (SELECT id FROM nodes) QUALIFY rank <= 10")
def neighbors_undirected(spark, d) -> DataFrame:
    ids = star.nodes(spark, d).select("id")
    return graph.neighbors(star.edges(spark, d), ids, 10).select("id", "type", "other", "rank")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def per_key_limit(spark, d) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return star.table(spark, d, "customer").withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("c_nationkey", "c_custkey", "rank")


CHAIN = "chain AS (SELECT 'c' || c_custkey AS node_id, 'c' || (c_custkey - 1) AS canonical_id FROM customer WHERE c_custkey % 16 <> 0)"


@query(f"WITH RECURSIVE {CHAIN}, r(node_id, canonical_id) AS (SELECT node_id, canonical_id FROM chain UNION ALL SELECT r.node_id, chain.canonical_id FROM r JOIN chain ON chain.node_id = r.canonical_id) SELECT node_id, canonical_id FROM r WHERE canonical_id NOT IN (SELECT node_id FROM chain)")
def flatten_map(spark, d) -> DataFrame:
    c = star.table(spark, d, "customer").filter("c_custkey % 16 <> 0")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    return graph.flatten_map(c.select(name(F.col("c_custkey")).alias("node_id"), name(F.col("c_custkey") - 1).alias("canonical_id")))


@query(f"{G}, g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), t AS MATERIALIZED (SELECT nodes.id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN g ON g.id = nodes.id ORDER BY degree DESC, nodes.id LIMIT 1500), k AS MATERIALIZED (SELECT least(3000, count(*)) AS n_edges FROM edges JOIN t a ON a.id = source JOIN t b ON b.id = target) SELECT t.id, t.degree, k.n_edges FROM t, k")
def degree_topn(spark, d) -> DataFrame:
    top, kept = graph.top_subgraph(star.nodes(spark, d), star.edges(spark, d), 1500, 3000)
    return top.join(F.broadcast(kept.agg(F.count("*").alias("n_edges"))))


@query(f"{G}, a AS (SELECT source, type, list_sort(list(DISTINCT target)) AS l FROM edges GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY type) AS k FROM a) SELECT source, type, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' (+' || (len(l) - 3) || ' more)' ELSE '' END AS targets, len(l)::INTEGER AS n FROM r WHERE k <= 5")
def edges_by_type(spark, d) -> DataFrame:
    return graph.edges_by_type(star.edges(spark, d))


@query(f"{G} SELECT 'label' AS kind, label AS value, count(*) AS n FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type")
def graph_metadata(spark, d) -> DataFrame:
    labels = star.nodes(spark, d).select(F.explode("labels").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    types = star.edges(spark, d).groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n"))
    return labels.select(F.lit("label").alias("kind"), "value", "n").unionByName(types.select(F.lit("type").alias("kind"), "value", "n"))


@query(f"{G}, x AS (SELECT * FROM edges WHERE type IN ('IN_NATION', 'IN_REGION')) SELECT id, name, n_links FROM (SELECT id, count(*) AS n_links FROM (SELECT unnest([source, target]) AS id FROM x) GROUP BY id) JOIN nodes USING (id)")
def viz_subgraph(spark, d) -> DataFrame:
    kept = star.edges(spark, d).filter(F.col("type").isin("IN_NATION", "IN_REGION"))
    return graph.degrees(kept).withColumnRenamed("degree", "n_links").join(star.nodes(spark, d).select("id", "name"), "id").select("id", "name", "n_links")


@query(f"{G} SELECT type, source, target FROM edges WHERE type IN ('PEER', 'PLACED') AND type NOT IN ('PLACED') ORDER BY type, source, target LIMIT 500")
def viz_query(spark, d) -> DataFrame:
    kept = filter_by(star.edges(spark, d), include=["PEER", "PLACED"], exclude=["PLACED"])
    return kept.select("type", "source", "target").orderBy("type", "source", "target").limit(500)


def filter_by(edges: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Edges of the included types but for the excluded; None: no filter."""
    if include is not None:
        edges = edges.filter(F.col("type").isin(include))
    return edges.filter(~F.col("type").isin(exclude)) if exclude is not None else edges


@query(f"{G} SELECT type, count(*) AS n FROM edges WHERE type NOT IN ('SUPPLIES') GROUP BY type")
def filter_predicates(spark, d) -> DataFrame:
    return filter_by(star.edges(spark, d), exclude=["SUPPLIES"]).groupBy("type").agg(F.count("*").alias("n"))


@query(f"{G} SELECT id, labels FROM nodes WHERE list_has_any(list_transform(labels, lambda x: upper(x)), ['BUILDING', 'ORGANIZATION'])")
def filter_labels(spark, d) -> DataFrame:
    wanted = F.array(F.lit("BUILDING"), F.lit("ORGANIZATION"))
    return star.nodes(spark, d).filter(F.arrays_overlap(F.transform("labels", lambda x: F.upper(x)), wanted)).select("id", "labels")


@query(f"{G} SELECT DISTINCT type FROM edges")
def list_predicates(spark, d) -> DataFrame:
    return star.edges(spark, d).select("type").distinct()


@query(f"{G} SELECT id FROM nodes WHERE NOT (id IN (SELECT node_id FROM remap))")
def skip_existing(spark, d) -> DataFrame:
    return star.nodes(spark, d).join(star.canonical_map(spark, d).withColumnRenamed("node_id", "id"), "id", "left_anti").select("id")


@query("WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7) % (SELECT max(o_custkey) + 1 FROM orders) AS b FROM orders), r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT b, depth + 1 FROM r JOIN l ON a = id WHERE depth < 12) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def crawl_bfs(spark, d) -> DataFrame:
    orders = star.table(spark, d, "orders").select("o_custkey")
    size = orders.agg(F.max("o_custkey") + 1).first()[0] or 1
    links = orders.distinct().select(F.col("o_custkey").alias("source"), (F.col("o_custkey") * 7 % size).alias("target"))
    return graph.bfs(links, spark.range(1, 2), 12)


@query(f"{G}, ids AS (SELECT id FROM nodes WHERE labels[1] IN ('Customer', 'Nation')) SELECT 'orphan' AS problem, u AS subject FROM (SELECT DISTINCT unnest([source, target]) AS u FROM edges) WHERE u NOT IN (SELECT id FROM ids) UNION ALL SELECT 'duplicate_edge_key', k FROM (SELECT source || '>' || type || '>' || target AS k, count(*) AS c FROM edges GROUP BY k) WHERE c > 1")
def validate_kg(spark, d) -> DataFrame:
    ids = star.nodes(spark, d).filter(F.get("labels", F.lit(0)).isin("Customer", "Nation"))
    missing = graph.orphans(star.edges(spark, d), ids).select(F.lit("orphan").alias("problem"), F.col("id").alias("subject"))
    keys = star.edges(spark, d).groupBy(F.concat_ws(">", "source", "type", "target").alias("subject")).agg(F.count("*").alias("c")).filter("c > 1")
    return missing.unionByName(keys.select(F.lit("duplicate_edge_key").alias("problem"), "subject"))


@query(f"{G} SELECT id, type, coalesce(nullif(source, ''), nullif(target, '')) AS first_end FROM edges WHERE source <> '' AND target <> ''")
def extract_relationship_records(spark, d) -> DataFrame:
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    kept = star.edges(spark, d).filter(nonempty("source").isNotNull() & nonempty("target").isNotNull())
    return kept.select("id", F.coalesce("type", F.lit("RELATED_TO")).alias("type"), F.coalesce(nonempty("source"), nonempty("target")).alias("first_end"))


@query("WITH f AS (SELECT user_id AS id, arg_min(event_type, event_id) AS first_node, arg_max(value, event_id) AS last_value, count(*) AS n FROM events GROUP BY user_id) SELECT * FROM f")
def load_fragments(spark, d) -> DataFrame:
    """The first node and the last relationship of an id win."""
    return star.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", "event_id").alias("first_node"), F.max_by("value", "event_id").alias("last_value"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def list_runs(spark, d) -> DataFrame:
    return star.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50)


@query("SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS has_extraction FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def has_extraction(spark, d) -> DataFrame:
    done = star.table(spark, d, "labels").select("doc_id").distinct().withColumn("_done", F.lit(True))
    return star.table(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left").select("doc_id", "source", F.col("_done").isNotNull().alias("has_extraction"))


@query("SELECT source, count(*) AS n_files, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_extracted FROM documents GROUP BY source")
def list_files(spark, d) -> DataFrame:
    return has_extraction(spark, d).groupBy("source").agg(F.count("*").alias("n_files"), F.count_if("has_extraction").alias("n_extracted"))


@query(f"{G}, {REMAPPED} SELECT (SELECT count(*) FROM edges) AS n_before, (SELECT count(*) FROM moved WHERE source = target) AS n_loops, (SELECT count(*) FROM (SELECT DISTINCT source, target, type FROM moved WHERE source <> target)) AS n_after")
def rewire_totals(spark, d) -> DataFrame:
    moved = graph.remap_endpoints(star.edges(spark, d), star.canonical_map(spark, d))
    grouped = moved.groupBy("source", "target", "type").agg(F.count("*").alias("c"))
    loop = F.col("source") == F.col("target")
    return grouped.agg(F.sum("c").alias("n_before"), F.coalesce(F.sum(F.when(loop, F.col("c"))), F.lit(0)).alias("n_loops"), F.count_if(~loop).alias("n_after"))


@query(f"{G} SELECT labels[1] AS label, count(*) AS n_nodes FROM nodes GROUP BY 1")
def count_graph_dir(spark, d) -> DataFrame:
    return star.nodes(spark, d).groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("n_nodes"))


@query(f"{G} SELECT n.id, n.name, r.canonical_id FROM nodes n JOIN remap r ON r.node_id = n.id")
def canonical_outputs(spark, d) -> DataFrame:
    remap = star.canonical_map(spark, d).withColumnRenamed("node_id", "id")
    return star.nodes(spark, d).join(remap, "id").select("id", "name", "canonical_id")


@query(f"{G} SELECT source, type, target FROM edges WHERE source <> target")
def delete_self_loops(spark, d) -> DataFrame:
    return star.edges(spark, d).filter("source <> target").select("source", "type", "target")


@query(f"""{G}, m AS (SELECT id, CASE WHEN id IN ('nation_3', 'nation_5') THEN 'nation_1' ELSE id END AS t FROM nodes),
w AS (SELECT a.t AS source, b.t AS target, type FROM edges JOIN m a ON a.id = source JOIN m b ON b.id = target WHERE a.t <> b.t)
SELECT source, target, type, count(*) AS merge_count FROM w GROUP BY ALL""")
def merge_entities(spark, d) -> DataFrame:
    nodes = star.nodes(spark, d).withColumn("aliases", F.array("name"))
    return graph.merge_entities(nodes, graph.valid_edges(star.edges(spark, d), nodes), "nation_1", ["nation_3", "nation_5"])[1].select("source", "target", "type", "merge_count")


@query(f"{G} SELECT labels[1] AS label, count(*) AS n, min(name) AS first_name FROM nodes GROUP BY 1 HAVING count(*) > 20")
def raw_query(spark, d) -> DataFrame:
    """Ad-hoc SQL over the views nodes and edges."""
    star.nodes(spark, d).createOrReplaceTempView("nodes")
    star.edges(spark, d).createOrReplaceTempView("edges")
    return spark.sql("SELECT labels[0] AS label, count(*) AS n, min(name) AS first_name FROM nodes GROUP BY labels[0] HAVING count(*) > 20")
