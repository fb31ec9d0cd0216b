"""Queries of entity search and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions import text as t
from graphkiln.functions.ship import ship
from graphkiln.operators import graph, resolution, search
from graphkiln.sources import star
from graphkiln.sources.star import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ALIASES = "[p_brand, p_type]"
LADDER = "CASE WHEN lower(p_name) = q THEN 1.0::DOUBLE WHEN contains(lower(p_name), q) THEN 0.9::DOUBLE WHEN lower(p_brand) = q OR lower(p_type) = q THEN 0.95::DOUBLE WHEN contains(lower(p_brand), q) OR contains(lower(p_type), q) THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END"
WORDS = "list_filter(string_split({x}, ' '), lambda w: w <> '')"
OVERLAP = f"len(list_intersect({WORDS.format(x='q')}, {WORDS.format(x='lower(p_name)')})) / len({WORDS.format(x='q')})::DOUBLE"


@query(f"WITH s AS (SELECT p_partkey, p_name, CASE WHEN l > 0 THEN l ELSE o END AS score FROM (SELECT *, {LADDER} AS l, {OVERLAP} AS o FROM part, (SELECT 'brand#1' AS q))) SELECT p_partkey, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50")
def lexical_score(spark, d) -> DataFrame:
    score = search.lexical_score("brand#1", F.col("p_name"), F.array("p_brand", "p_type"))
    return search.top(table(spark, d, "part"), score, 50, "p_partkey").select("p_partkey", F.round("score", 4).alias("score"))


@query(f"WITH s AS (SELECT p_partkey, greatest({LADDER}, 0.7::DOUBLE * {OVERLAP}) AS l, p_size / 50.0::DOUBLE AS v FROM part, (SELECT 'brass' AS q)), f AS (SELECT p_partkey, CASE WHEN l >= 0.8 THEN 0.4::DOUBLE * v + 0.6::DOUBLE * l ELSE 0.6::DOUBLE * v + 0.4::DOUBLE * l END AS score FROM s) SELECT p_partkey, round(score, 4) AS score FROM f WHERE score > 0 ORDER BY f.score DESC, p_partkey LIMIT 50")
def hybrid_score(spark, d) -> DataFrame:
    score = search.hybrid_score("brass", F.col("p_name"), F.array("p_brand", "p_type"), F.col("p_size") / F.lit(50.0))
    return search.top(table(spark, d, "part"), score, 50, "p_partkey").select("p_partkey", F.round("score", 4).alias("score"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'brand#11' THEN 100 WHEN lower(p_brand) = 'brand#11' THEN 95 WHEN contains(lower(p_brand), 'brand#11') THEN 90 WHEN contains(lower(p_name), 'brand#11') THEN 80 WHEN contains(lower(p_type), 'brand#11') THEN 60 END AS score FROM part WHERE contains(lower(p_name), 'brand#11') OR contains(lower(p_brand), 'brand#11') OR contains(lower(p_type), 'brand#11')")
def fragment_score(spark, d) -> DataFrame:
    score = search.fragment_entity_score("Brand#11", F.col("p_name"), F.array("p_brand"), F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", score.alias("score")).filter("score IS NOT NULL")


@query(f"WITH {star.NODES_SQL}, {star.EDGES_SQL} SELECT type, source, CASE WHEN lower(type) = 'nation' THEN 100 WHEN contains(lower(s.name), 'nation') OR contains(lower(t.name), 'nation') THEN 70 WHEN contains(lower(type), 'nation') THEN 50 END AS score FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target")
def fragment_edge_score(spark, d) -> DataFrame:
    rows = graph.edge_pattern(star.edges(spark, d), star.nodes(spark, d))
    none = F.array().cast("array<string>")
    score = search.fragment_edge_score("nation", F.col("type"), none, F.col("source_name"), none, F.col("target_name"), none)
    return rows.select("type", "source", score.alias("score"))


@query(r"WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[_\-/\\.]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g')) AS n, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_brand), '[_\-/\\.]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS a, lower(p_type) AS ty FROM part) SELECT p_partkey, greatest(CASE WHEN n = 'brand 11' THEN 100.0::DOUBLE ELSE 0.0 END, CASE WHEN a = 'brand 11' THEN 95.0 ELSE 0.0 END, CASE WHEN contains(a, 'brand 11') THEN 90.0 ELSE 0.0 END, CASE WHEN contains(ty, 'brass') THEN 70.0 ELSE 0.0 END)::DOUBLE AS score FROM n WHERE a = 'brand 11' OR contains(ty, 'brass')")
def entity_score(spark, d) -> DataFrame:
    score = search.entity_score(F.array(F.lit("Brand#11"), F.lit("brass")), F.col("p_name"), F.array("p_brand"), F.lower("p_type"), F.array().cast("array<string>"), F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", score.alias("score")).filter("score > 0")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'part') ORDER BY p_partkey LIMIT 20")
def search_ci(spark, d) -> DataFrame:
    return table(spark, d, "part").filter(F.lower("p_name").contains("part")).select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


@query("WITH f AS (SELECT p_partkey, 70.0::DOUBLE AS score FROM part WHERE contains(lower(p_type), 'brass') UNION ALL SELECT p_partkey, 95.0 FROM part WHERE p_size > 45) SELECT p_partkey, max(score) AS score FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def entity_search(spark, d) -> DataFrame:
    """Two sources of hits; the best of each entity."""
    part = table(spark, d, "part")
    hits = part.filter(F.lower("p_type").contains("brass")).select("p_partkey", F.lit(70.0).alias("score")).unionByName(part.filter("p_size > 45").select("p_partkey", F.lit(95.0).alias("score")))
    return hits.groupBy("p_partkey").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(30)


@query("WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS score FROM lineitem GROUP BY ALL), t AS (SELECT * FROM e ORDER BY score DESC, s, p LIMIT 15) SELECT 'edge' AS kind, s || '-' || p AS id, score FROM t UNION ALL SELECT * FROM (SELECT 'entity', s::VARCHAR, max(score) FROM e GROUP BY s ORDER BY 3 DESC, s LIMIT 10)")
def context_topk(spark, d) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.max("l_quantity").alias("score"))
    edges = e.orderBy(F.desc("score"), "s", "p").limit(15).select(F.lit("edge").alias("kind"), F.concat_ws("-", F.col("s").cast("string"), F.col("p").cast("string")).alias("id"), "score")
    entities = e.groupBy("s").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "s").limit(10)
    return edges.unionByName(entities.select(F.lit("entity").alias("kind"), F.col("s").cast("string").alias("id"), "score"))


@query("WITH hits AS (SELECT c_custkey AS id, 1.0::DOUBLE AS score FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT o_custkey, 0.5 FROM orders WHERE o_totalprice > 490000), best AS (SELECT id, max(score) AS score FROM hits GROUP BY id) SELECT id, score, (row_number() OVER (ORDER BY score DESC, id) - 1)::INTEGER AS ref FROM best ORDER BY score DESC, id LIMIT 100")
def graph_context(spark, d) -> DataFrame:
    """Entities from two retrievals with their best score, numbered for reference (a bounded list)."""
    hits = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_custkey").alias("id"), F.lit(1.0).alias("score"))
    hits = hits.unionByName(table(spark, d, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("id"), F.lit(0.5).alias("score")))
    best = hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(100)
    return best.withColumn("ref", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


RECORDS = "WITH r AS (SELECT user_id AS id, event_id % 5 AS f, event_id AS pos, event_type, props FROM events)"


def _records(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("source_file"), F.array("event_type").alias("labels"), F.concat(F.lit("User "), F.col("event_type")).alias("name"), F.array("event_type").alias("aliases"), F.array("event_type").alias("description"))


@query(f"{RECORDS}, o AS (SELECT id, event_type, min('f' || f || lpad(pos::VARCHAR, 12, '0')) AS k FROM r GROUP BY ALL) SELECT id, min(f) AS source_file, list(event_type ORDER BY k) AS labels, list_sort(list(event_type)) AS description, (SELECT count(*) FROM r WHERE r.id = o.id) AS n_records FROM (SELECT id, event_type, k, left(k, 2) AS f FROM o) o GROUP BY id")
def merge_nodes_stage1(spark, d) -> DataFrame:
    return resolution.merge_records(_records(spark, d)).select("id", "source_file", "labels", "description", "n_records")


@query(f"{RECORDS}, o AS (SELECT id, event_type, min('f' || f || lpad(pos::VARCHAR, 12, '0')) AS k FROM r GROUP BY ALL) SELECT id, list(event_type ORDER BY k) AS aliases FROM o GROUP BY id")
def merge_nodes_rewire(spark, d) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("source_file", "pos", F.col("aliases").alias("x")))), lambda x: x["x"])
    return _records(spark, d).groupBy("id").agg(t.aliases(F.array_distinct(F.flatten(order))).alias("aliases"))


@query(f"{RECORDS} SELECT id, arg_max(event_type, (length(event_type), -pos)) AS value, list_sort(list(DISTINCT event_type)) AS kinds FROM r GROUP BY id")
def merge_rule_based(spark, d) -> DataFrame:
    """Of scalars the longest stays, the first of equally long ones."""
    r = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("pos"))
    return r.groupBy("id").agg(resolution.longest("event_type", "pos").alias("value"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query(f"{RECORDS} SELECT id, list_sort(list(DISTINCT 'f' || f)) AS lineage FROM r GROUP BY id HAVING count(*) > 1")
def backfill_lineage(spark, d) -> DataFrame:
    merged = _records(spark, d).groupBy("id").agg(F.array_sort(F.collect_set("source_file")).alias("lineage"), F.count("*").alias("n")).filter("n > 1")
    return merged.select("id", "lineage")


LOOK = "length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) AS u, length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) AS l"
TOKENS = "list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda x: length(x) > 1)"
SHORT = "CASE WHEN length({x}) <= 3 THEN 4.0 WHEN {n} = 1 AND {x} = upper({x}) AND {x} <> lower({x}) AND length({x}) <= 6 THEN 3.0 WHEN {n} <= 2 AND length({x}) <= 8 THEN 1.5 ELSE 0.0 END::DOUBLE"
LONG = "(CASE WHEN length({x}) > 90 THEN 3.0 WHEN length({x}) > 65 THEN 1.5 ELSE 0.0 END + CASE WHEN {n} > 12 THEN 2.0 WHEN {n} > 9 THEN 1.0 ELSE 0.0 END + CASE WHEN length(regexp_replace({x}, '[^,;:.]', '', 'g')) >= 2 THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches({x}, '(?i)\\b(refers|same|under|located|based)\\b') THEN 2.0 ELSE 0.0 END)::DOUBLE"


@query(f"""WITH n AS (SELECT p_brand AS id, unnest([p_name, p_type, p_brand]) AS text FROM part), k AS (SELECT *, lower(text) AS form, {LOOK.format(x="text")} FROM n WHERE text <> ''),
f AS (SELECT id, form, count(*) AS uses, max(ROW(u, l, -length(text), text)) AS best, arg_max(text, ROW(u, l, -length(text), text)) AS text, max(ROW(u, l, -length(text))) AS look FROM k GROUP BY id, form),
t AS (SELECT *, list_distinct({TOKENS.format(x="form")}) AS w FROM f), g AS (SELECT a.id, a.form, a.w AS x, b.w AS y, len(list_intersect(a.w, b.w)) AS shared FROM t a JOIN t b ON a.id = b.id AND a.form <> b.form WHERE len(a.w) > 0 AND len(b.w) > 0),
h AS (SELECT id, form, least(3.0, sum(CASE WHEN shared = len(x) AND len(y) > len(x) THEN 1.5 WHEN shared = len(y) THEN 0.5 ELSE shared / len(y)::DOUBLE * 0.25 END))::DOUBLE AS fit FROM g GROUP BY id, form),
s AS (SELECT t.id, t.text, t.look, t.uses * 2.0::DOUBLE + coalesce(h.fit, 0) - {SHORT.format(x="t.text", n="len(t.w)")} - {LONG.format(x="t.text", n="len(t.w)")} AS score FROM t LEFT JOIN h USING (id, form))
SELECT id, arg_max(text, ROW(score, -abs(length(text) - 35), -length(text), look, text)) AS name FROM s GROUP BY id""")
def canonical_name(spark, d) -> DataFrame:
    uses = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.explode(F.array("p_name", "p_type", "p_brand")).alias("name"))
    return resolution.canonical_names(uses)


@query("""WITH RECURSIVE m AS (SELECT label AS cluster, vec_id AS id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 = 0 THEN 'kind' ELSE 'kind ' || vec_id % 4 END AS name, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
n AS (SELECT b.cluster, b.id, b.r, list(a.id ORDER BY a.id) FILTER (a.id IS NOT NULL) AS near FROM m b LEFT JOIN m a ON a.cluster = b.cluster AND a.r < b.r AND list_cosine_similarity(a.e, b.e) >= 0.30 AND (contains(a.name, b.name) OR contains(b.name, a.name)) GROUP BY ALL),
w(cluster, r, seeds) AS (SELECT DISTINCT cluster, 0::BIGINT, []::BIGINT[] FROM m UNION ALL SELECT w.cluster, n.r, CASE WHEN list_has_any(coalesce(n.near, []), w.seeds) THEN w.seeds ELSE list_append(w.seeds, n.id) END FROM w JOIN n ON n.cluster = w.cluster AND n.r = w.r + 1),
z AS (SELECT cluster, arg_max(seeds, r) AS seeds FROM w GROUP BY cluster)
SELECT n.cluster, n.id AS node_id, coalesce(list_min(list_intersect(n.near, z.seeds)), n.id) AS seed FROM n JOIN z USING (cluster)""")
def conservative_merge(spark, d) -> DataFrame:
    """A name like "kind 1" holds only itself and "kind", which all names hold."""
    k = (F.col("vec_id") % 4).cast("string")
    names = F.array(F.when(k == "0", "Kind").otherwise(F.concat(F.lit(" kind "), k)))
    members = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("node_id"), names.alias("names"), F.col("embedding").alias("vector"))
    return resolution.conservative_groups(members, 0.30)


@query(f"""WITH n AS (SELECT item_id, trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS x FROM benchmark), k AS (SELECT *, replace(lower(x), 'ß', 'ss') AS name_key FROM n)
SELECT item_id, name_key, {TOKENS.format(x="name_key")} AS tokens, {LOOK.format(x="x")}, length(x)::BIGINT AS size FROM k""")
def name_key(spark, d) -> DataFrame:
    """Key, tokens and display quality (capitals, letters, length) of names; long ones are whole texts here."""
    x = t.collapse(F.col("text"))
    count = lambda kind: F.length(F.regexp_replace(x, f"[^\\p{{{kind}}}]", "")).cast("long")
    return table(spark, d, "benchmark").select("item_id", t.name_key(x).alias("name_key"), t.name_tokens(x).alias("tokens"), count("Lu").alias("u"), count("L").alias("l"), F.length(x).cast("long").alias("size"))


@query(f"""WITH n AS (SELECT 'text' AS kind, item_id AS id, trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS x FROM benchmark UNION ALL SELECT 'type', p_partkey, p_type FROM part UNION ALL SELECT 'brand', p_partkey, left(p_type, 3) FROM part), w AS (SELECT *, len({TOKENS.format(x="replace(lower(x), 'ß', 'ss')")}) AS n FROM n)
SELECT kind, id, {SHORT.format(x="x", n="n")} AS short, {LONG.format(x="x", n="n")} AS long FROM w""")
def name_penalties(spark, d) -> DataFrame:
    parts = table(spark, d, "part")
    rows = table(spark, d, "benchmark").select(F.lit("text").alias("kind"), F.col("item_id").alias("id"), t.collapse(F.col("text")).alias("x"))
    rows = rows.unionAll(parts.select(F.lit("type"), "p_partkey", "p_type")).unionAll(parts.select(F.lit("brand"), "p_partkey", F.left("p_type", F.lit(3))))
    n = F.size(t.name_tokens(F.col("x")))
    return rows.select("kind", "id", resolution.short_penalty(F.col("x"), n).alias("short"), resolution.long_penalty(F.col("x"), n).alias("long"))


@query("SELECT label AS cluster, CASE WHEN vec_id % 3 = 0 THEN 'single_' || vec_id ELSE (vec_id % 2)::VARCHAR END AS grp, vec_id AS node_id FROM embeddings")
def partition_repair(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("node_id"))
    asked = base.filter("node_id % 3 <> 0").select("cluster", (F.col("node_id") % 2).alias("grp"), F.lit(0).alias("pos"), "node_id")
    again = base.filter("node_id % 3 = 1").select("cluster", F.lit(7).cast("long").alias("grp"), F.lit(1).alias("pos"), (F.col("node_id")).alias("node_id"))
    unknown = base.limit(5).select("cluster", F.lit(3).cast("long").alias("grp"), F.lit(0).alias("pos"), (F.col("node_id") + 10_000_000).alias("node_id"))
    return resolution.repair_partition(base, asked.unionByName(again).unionByName(unknown))


@query("SELECT p_partkey, 'n_' || p_size || CASE WHEN r = 1 THEN '' ELSE '_' || r END AS unique_id FROM (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part)")
def id_suffixing(spark, d) -> DataFrame:
    based = table(spark, d, "part").select("p_partkey", F.concat(F.lit("n_"), F.col("p_size").cast("string")).alias("base"))
    return resolution.unique_ids(based, "base", "p_partkey").select("p_partkey", "unique_id")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 1 THEN 'merged' ELSE 'kept' END AS state FROM customer UNION ALL SELECT 'new' FROM supplier) GROUP BY state")
def incremental_result(spark, d) -> DataFrame:
    existing = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = existing.filter("id % 10 = 1").select((F.col("id") + 10_000_000).alias("id"), "name", F.col("id").alias("match"))
    added = table(spark, d, "supplier").select((F.col("s_suppkey") + 20_000_000).alias("id"), F.col("s_name").alias("name"), F.lit(-1).cast("long").alias("match"))
    return resolution.incremental(existing, new.unionByName(added))[1]


@query("SELECT node_id, canonical_id FROM (SELECT vec_id AS node_id, min(vec_id) OVER (PARTITION BY label, vec_id % 40) AS canonical_id FROM embeddings) WHERE node_id <> canonical_id")
def id_remap_proposals(spark, d) -> DataFrame:
    proposals = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 40).alias("k")).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).filter("size(ids) > 1")
    return proposals.select(F.explode("ids").alias("node_id"), F.get("ids", F.lit(0)).alias("canonical_id")).filter("node_id <> canonical_id")


@query("WITH p AS (SELECT a.label AS cluster, a.vec_id % 7 = b.vec_id % 7 AS same FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT cluster, NOT bool_or(same) AS source_ok FROM p GROUP BY cluster")
def validate_source(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("a"))
    other = e.select("cluster", F.col("a").alias("b"))
    pairs = e.join(other, "cluster").filter("a < b").select("cluster", F.lit(1.0).alias("name_sim"), F.lit(1.0).alias("alias_sim"), (F.col("a") % 7 == F.col("b") % 7).alias("same_source"))
    return resolution.pair_checks(pairs).select("cluster", "source_ok")
