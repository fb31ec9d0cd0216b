"""Further queries: records and their properties, sinks by key, clusters' checks, model-driven steps with the default provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.functions import text as t
from graphkiln.functions.ship import ship
from graphkiln.operators import documents, graph, rag, resolution, vectors
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


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2', 'none')")
def scan_selected(spark, d) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.array(F.lit("src1"), F.lit("src2"), F.lit("none"))).alias("source"))
    return table(spark, d, "documents").join(F.broadcast(wanted), "source", "left_semi").select("doc_id", "source", "lang")


@query("SELECT vec_id, label, len(embedding)::INTEGER AS dim FROM embeddings WHERE embedding IS NOT NULL")
def scan_all_embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def scan_existing_entities(spark, d) -> DataFrame:
    asked = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(asked, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""WITH h AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || ('vec_' || vec_id)::BLOB) AS h FROM embeddings)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, label, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN vec_id % 4 = 0 THEN list_reverse(embedding) ELSE embedding END AS vector FROM h""")
def sink_embeddings_upsert(spark, d) -> DataFrame:
    """A store of vectors under name-based ids, into which new vectors of some are merged by id."""
    rows = table(spark, d, "embeddings").withColumn("id", t.uuid5(F.concat(F.lit("vec_"), F.col("vec_id").cast("string"))))
    old = rows.select("id", "label", F.lit(1).alias("version"), F.col("embedding").alias("vector"))
    new = rows.filter("vec_id % 4 = 0").select("id", "label", F.lit(2).alias("version"), F.reverse("embedding").alias("vector"))
    return graph.upsert_nodes(old, new)


@query(None)
def sink_chunks(spark, d) -> DataFrame:
    """The chunks of all documents with their vectors, upserted by a key that depends on the document and place only."""
    made = documents.chunks(table(spark, d, "documents"))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    rows = made.select(t.uuid5(key).alias("chunk_id"), "doc_id", "chunk_index", "text")
    vector = vectors.hash_embedding(rows, "chunk_id", "text", 32)
    return graph.upsert_nodes(rows.limit(0).withColumn("version", F.lit(0)), rows.withColumn("version", F.lit(1)), "chunk_id").join(vector, "chunk_id", "left")


@query("SELECT event_id, event_type AS name, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'error' THEN ['k', 'tags'] ELSE ['k', 'nested', 'tags'] END AS kept FROM events WHERE props <> ''")
def clean_properties(spark, d) -> DataFrame:
    """Scalars and lists of scalars stay; maps and the embedding go."""
    nested = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("event_type"))
    more = F.map_from_arrays(F.array(*[F.lit(x) for x in ("embedding", "nested", "tags")]), F.array(F.lit("[0.1]"), nested, F.lit('["x"]')))
    kept = F.map_filter(F.map_concat(F.from_json("props", "map<string,string>"), more), lambda k, v: (k != "embedding") & ~v.startswith("{"))
    rows = table(spark, d, "events").filter("props <> ''").select("event_id", F.col("event_type").alias("name"), kept.alias("m"))
    return rows.select("event_id", "name", F.try_element_at("m", F.lit("k")).alias("k"), F.array_sort(F.map_keys("m")).alias("kept"))


@query("SELECT p_partkey, p_name AS name, p_brand || ' ' || p_type AS description FROM part")
def normalize_properties(spark, d) -> DataFrame:
    """Names collapsed; lists of descriptions joined by a space."""
    return table(spark, d, "part").select("p_partkey", t.collapse(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name"), F.array_join(F.array("p_brand", "p_type"), " ").alias("description"))


@query("SELECT n_nationkey AS cluster, list(s_suppkey ORDER BY s_suppkey) AS members, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) > 0")
def cluster_items(spark, d) -> DataFrame:
    joined = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_nationkey").alias("cluster")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("members"), F.count("s_suppkey").alias("n")).filter("n > 0")


@query("SELECT label, CASE WHEN avg_sim >= 0.01 THEN 'person' ELSE 'split' END AS decision FROM (SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS avg_sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)")
def resolve_cluster(spark, d) -> DataFrame:
    """A cluster that is alike enough is merged, else split."""
    inner = vectors.intra_similarity(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return inner.select(F.col("cluster").alias("label"), F.when(F.col("similarity") >= 0.01, "person").otherwise("split").alias("decision"))


@query("SELECT a.n_regionkey AS cluster, count(*) AS n_pairs, bool_and(round(100.0 * 2 * (7 + CASE WHEN list_has_any(string_split(substr(a.n_name, 8), ''), string_split(substr(b.n_name, 8), '')) THEN 1 ELSE 0 END) / (length(a.n_name) + length(b.n_name))) / 100 >= 0.8) AS person_ok FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1")
def validate_person(spark, d) -> DataFrame:
    ship(spark)
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("a"), F.lower("n_name").alias("x"))
    pairs = n.join(n.select("cluster", F.col("a").alias("b"), F.col("x").alias("y")), "cluster").filter("a < b")
    pairs = pairs.withColumn("name_sim", resolution.name_similarity("x", "y")).withColumns({"alias_sim": F.lit(0.0), "same_source": F.lit(False)})
    counts = pairs.groupBy("cluster").agg(F.count("*").alias("n_pairs"))
    return counts.join(resolution.pair_checks(pairs).select("cluster", "person_ok"), "cluster")


@query("SELECT event_id, event_type AS label, event_type <> 'error' AS valid FROM events")
def judge_triplet(spark, d) -> DataFrame:
    """A judge's JSON answers parsed and checked."""
    label = F.when(F.col("event_type") == "error", "nonsense").otherwise("correct")
    answer = F.concat(F.lit('text {"label": "'), label, F.lit('", "confidence": 0.9, "reason": "fine"} more'))
    rows = table(spark, d, "events").select("event_id", "event_type", rag.judgement(answer).alias("j"))
    return rows.select("event_id", F.when(F.col("j.label") == "supported", F.col("event_type")).otherwise("error").alias("label"), "j.valid")


@query("SELECT event_id, NOT contains(event_type, 'error') AS consistent FROM events")
def reason_consistency(spark, d) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "so it is contradicted").otherwise("so it holds")
    return table(spark, d, "events").select("event_id", rag.consistent(F.lit("supported"), reason).alias("consistent"))


@query("SELECT item_id, 'top: ' || text AS answer, 1::INTEGER AS tries FROM benchmark")
def synthesize(spark, d) -> DataFrame:
    """Answers by the default provider: the best passage."""
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return rag.ask(rows, "prompt", lambda p: f"top: {p}").select("item_id", "answer", "tries")


@query("SELECT mode, CASE WHEN mode IN ('semantic_search', 'hybrid') THEN ['c'] END AS chunks, CASE WHEN mode IN ('naive_grag', 'graph_search', 'hybrid') THEN ['f'] END AS facts FROM (SELECT unnest(['direct', 'semantic_search', 'naive_grag', 'graph_search', 'hybrid']) AS mode)")
def mode_evidence(spark, d) -> DataFrame:
    modes = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in rag.MODES])).alias("mode"))
    return modes.select("mode", rag.evidence_mode(F.col("mode"), F.array(F.lit("c")), F.array(F.lit("f"))).alias("e")).select("mode", "e.chunks", "e.facts")


ESCAPED = r"""regexp_replace({x}, '([+\-!(){{}}\[\]^"~*?:\\/&|])', '\\\1', 'g')"""


@query("SELECT p_partkey, '\"' || " + ESCAPED.format(x="p_brand || ' (x) y+z'") + " || '\" OR ' || " + ESCAPED.format(x="p_brand || '-1'") + " || ' OR ' || " + ESCAPED.format(x="p_brand || '-1'") + " || '*' AS clause FROM part")
def lucene_query(spark, d) -> DataFrame:
    """A phrase and a word, both with characters to escape, and a blank term."""
    terms = F.array(F.concat("p_brand", F.lit(" (x) y+z")), F.lit(" "), F.concat("p_brand", F.lit("-1")))
    return table(spark, d, "part").select("p_partkey", rag.lucene(terms).alias("clause"))


@query("SELECT p_partkey, [p_brand, p_type[1:3]] AS merged FROM part WHERE lower(p_type[1:3]) <> lower(p_brand)")
def keyword_merge(spark, d) -> DataFrame:
    start = F.left("p_type", F.lit(3))
    rows = table(spark, d, "part").filter(F.lower(start) != F.lower("p_brand"))
    return rows.select("p_partkey", rag.merge_keywords([F.array("p_brand"), F.array(start, F.upper(F.col("p_brand")))], 2).alias("merged"))


@query("SELECT event_id, '[{\"id\":' || user_id || '}]' AS entities FROM events")
def context_format(spark, d) -> DataFrame:
    rows = table(spark, d, "events")
    none = F.array().cast("array<string>")
    made = rag.context_text(F.array(F.struct(F.col("user_id").alias("id"))), none, none, none)
    return rows.select("event_id", rag.context_section(made, "Entities").alias("entities"))


@query("SELECT conv_id, turn, least(8, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::INTEGER AS n FROM conversations")
def compact_reasoning(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(rag.reasoning_steps(F.col("text"), 8)).alias("n"))


@query("SELECT id, chain_end FROM (SELECT vec_id AS id, vec_id // 8 * 8 AS chain_end FROM embeddings)")
def merge_existing_into_canonical(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    remap = base.filter("id % 8 <> 0").select(F.col("id").alias("node_id"), (F.col("id") - 1).alias("canonical_id"))
    flat = graph.flatten_map(remap)
    return base.join(flat.withColumnRenamed("node_id", "id"), "id", "left").select("id", F.coalesce("canonical_id", "id").alias("chain_end"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM conversations GROUP BY role")
def conversation_roles(spark, d) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


U = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - list_cosine_similarity(a.e, b.e)) FILTER (a.vec_id <> b.vec_id) AS m FROM u a, u b GROUP BY ALL), s AS (SELECT vec_id, label, max(m) FILTER (other = label) AS inner_, min(m) FILTER (other <> label) AS outer_ FROM d GROUP BY ALL)"


@query(f"{U} SELECT round(avg((outer_ - inner_) / greatest(outer_, inner_)), 6) AS silhouette FROM s")
def silhouette(spark, d) -> DataFrame:
    """Mean silhouette under cosine distance from the clusters' summed unit vectors: linear, without pairs."""
    base = table(spark, d, "embeddings")
    size = vectors.norm(F.col("embedding"))
    unit = base.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") / size).alias("u"))
    cells = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    sums = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda c: c["s"]).alias("sum")).join(unit.groupBy("label").agg(F.count("*").alias("n")), "label")
    other = sums.select(F.col("label").alias("other"), "sum", "n")
    rows = unit.join(F.broadcast(other)).withColumn("dot", vectors.dot(F.col("u"), F.col("sum")))
    own = F.col("other") == F.col("label")
    mean = F.when(own, 1 - (F.col("dot") - 1) / (F.col("n") - 1)).otherwise(1 - F.col("dot") / F.col("n"))
    per = rows.withColumn("m", mean).groupBy("vec_id", "label").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    return per.agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"))
