"""Queries over embeddings and hashed names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.operators import vectors
from graphkiln.sources.star import table

QUERIES: dict = {}
ORACLES: dict = {}
THRESHOLD = 0.30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


V = "WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
PAIRS = f"{V}, p AS (SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD})"
LINKS = f"{PAIRS}, l AS (SELECT a AS u, b AS w FROM p UNION SELECT b, a FROM p), r(id, node) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.w FROM r JOIN l ON r.node = l.u), c AS (SELECT id, min(node) AS root FROM r GROUP BY id), lab AS (SELECT c.id, v.label AS block, root FROM c JOIN v ON v.vec_id = c.id), s AS (SELECT block, root, count(*) AS size, min(id) AS first FROM lab GROUP BY ALL), num AS (SELECT block, root, row_number() OVER (PARTITION BY block ORDER BY first) - 1 AS no FROM s WHERE size > 1), asg AS (SELECT lab.id, lab.block, coalesce(lower(lab.block::VARCHAR) || '_' || lpad(no::VARCHAR, 4, '0'), 'noise') AS cluster_id, CASE WHEN no IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS probability FROM lab LEFT JOIN num ON num.block = lab.block AND num.root = lab.root)"


def _pairs(spark, d) -> DataFrame:
    return vectors.threshold_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", THRESHOLD)


def _labelled(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings")
    roots = vectors.components(_pairs(spark, d), base.select(F.col("vec_id").alias("id")))
    return roots.join(base.select(F.col("vec_id").alias("id"), F.col("label").alias("block")), "id")


@query(f"{PAIRS} SELECT block, a, b, round(sim, 6) AS sim FROM p")
def pairwise_threshold(spark, d) -> DataFrame:
    return _pairs(spark, d).withColumn("sim", F.round("sim", 6))


@query(f"{LINKS} SELECT * FROM asg")
def threshold_components(spark, d) -> DataFrame:
    return vectors.number_clusters(_labelled(spark, d))


@query(f"{LINKS} SELECT cluster_id, count(*) AS size, min(id) AS first_id FROM asg GROUP BY cluster_id")
def cluster_numbering(spark, d) -> DataFrame:
    return vectors.number_clusters(_labelled(spark, d)).groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


@query(f"{LINKS}, z AS (SELECT cluster_id, count(*) AS size FROM asg GROUP BY 1) SELECT count(*) FILTER (cluster_id <> 'noise') AS num_clusters, coalesce(sum(size) FILTER (cluster_id = 'noise'), 0)::BIGINT AS num_noise, max(size) FILTER (cluster_id <> 'noise') AS max_size, min(size) FILTER (cluster_id <> 'noise') AS min_size, round(avg(size) FILTER (cluster_id <> 'noise'), 9) AS avg_size FROM z")
def cluster_metrics(spark, d) -> DataFrame:
    return vectors.cluster_metrics(vectors.number_clusters(_labelled(spark, d))).withColumn("avg_size", F.round("avg_size", 9))


@query(f"{LINKS} SELECT cluster_id, list_sort(list(id)) AS node_ids FROM asg WHERE cluster_id <> 'noise' GROUP BY cluster_id")
def build_cluster_groups(spark, d) -> DataFrame:
    assigned = vectors.number_clusters(_labelled(spark, d)).filter("cluster_id <> 'noise'")
    return assigned.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("node_ids"))


@query(f"{LINKS} SELECT cluster_id, bool_or(id % 5 = 0) AS has_new FROM asg WHERE cluster_id <> 'noise' GROUP BY 1 HAVING bool_or(id % 5 = 0)")
def groups_with_new(spark, d) -> DataFrame:
    assigned = vectors.number_clusters(_labelled(spark, d)).filter("cluster_id <> 'noise'")
    return assigned.groupBy("cluster_id").agg(F.bool_or(F.col("id") % 5 == 0).alias("has_new")).filter("has_new")


@query(f"{V} SELECT a.label AS cluster, (SELECT count(*) FROM v w WHERE w.label = a.label) AS n, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def intra_similarity(spark, d) -> DataFrame:
    return vectors.intra_similarity(table(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumn("similarity", F.round("similarity", 6))


@query(f"{V}, g AS (SELECT label, vec_id % 3 AS k, avg(list_cosine_similarity(a.e, b.e)) AS s FROM (SELECT label, vec_id, e FROM v) a JOIN (SELECT label AS l2, vec_id AS v2, e FROM v) b ON l2 = label AND v2 % 3 = vec_id % 3 AND vec_id < v2 GROUP BY ALL) SELECT label, bool_and(s >= 0.01) AS valid FROM g GROUP BY label")
def validate_subgroups(spark, d) -> DataFrame:
    """Every subgroup of a cluster must be alike enough, else the whole cluster is rejected."""
    base = table(spark, d, "embeddings").withColumn("_group", F.concat_ws(":", F.col("label").cast("string"), (F.col("vec_id") % 3).cast("string")))
    inner = vectors.intra_similarity(base, "vec_id", "embedding", "_group")
    return inner.groupBy(F.split_part("cluster", F.lit(":"), F.lit(1)).cast("int").alias("label")).agg(F.bool_and(F.col("similarity") >= 0.01).alias("valid"))


TOP = "row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank"


@query(f"{V} SELECT id, round(score, 6) AS score, rank FROM (SELECT *, {TOP} FROM (SELECT q.vec_id AS query, b.vec_id AS id, list_cosine_similarity(q.e, b.e) AS score FROM v q, v b WHERE q.vec_id = (SELECT min(vec_id) FROM v))) WHERE rank <= 10")
def knn_search(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings")
    first = base.join(F.broadcast(base.agg(F.min("vec_id").alias("vec_id"))), "vec_id", "left_semi")
    return vectors.nearest(first, base, "vec_id", "embedding", 10).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"{V} SELECT query, id, round(score, 4) AS score FROM (SELECT *, {TOP} FROM (SELECT q.vec_id AS query, b.vec_id AS id, list_cosine_similarity(q.e, b.e) AS score FROM v q, v b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id)) WHERE rank <= 5")
def similar_entities(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings")
    return vectors.nearest(base.filter("vec_id % 20 = 0"), base, "vec_id", "embedding", 5, skip_self=True).select("query", "id", F.round("score", 4).alias("score"))


@query(f"{V}, n AS (SELECT *, {TOP} FROM (SELECT q.vec_id AS query, b.vec_id AS id, list_cosine_similarity(q.e, b.e) AS score FROM v q, v b)) SELECT DISTINCT least(query, id) AS a, greatest(query, id) AS b, round(score, 6) AS score FROM n WHERE rank <= 5 AND query <> id AND score >= {THRESHOLD}")
def duplicate_pairs(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings")
    near = vectors.nearest(base, base, "vec_id", "embedding", 5).filter("query <> id").filter(F.col("score") >= THRESHOLD)
    return near.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), F.round("score", 6).alias("score")).distinct()


@query(f"{V}, n AS (SELECT *, {TOP} FROM (SELECT q.vec_id AS query, b.vec_id AS id, list_cosine_similarity(q.e, b.e) AS score FROM v q, v b WHERE q.vec_id % 20 = 0 AND b.vec_id % 20 <> 0) WHERE score >= {THRESHOLD}) SELECT query AS new_id, list_sort(list(id)) AS candidates FROM n WHERE rank <= 5 GROUP BY query")
def candidate_fetch(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings")
    near = vectors.nearest(base.filter("vec_id % 20 = 0"), base.filter("vec_id % 20 <> 0"), "vec_id", "embedding", 5, THRESHOLD)
    return near.groupBy(F.col("query").alias("new_id")).agg(F.array_sort(F.collect_list("id")).alias("candidates"))


@query("SELECT vec_id, CASE WHEN vec_id % 20 = 0 THEN 'new' ELSE 'existing' END AS origin FROM embeddings WHERE vec_id % 20 = 0 OR vec_id % 3 = 0")
def union_candidates(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings").select("vec_id")
    both = base.filter("vec_id % 20 = 0").select("vec_id", F.lit("new").alias("origin"), F.lit(0).alias("p")).unionByName(base.filter("vec_id % 3 = 0").select("vec_id", F.lit("existing").alias("origin"), F.lit(1).alias("p")))
    return both.groupBy("vec_id").agg(F.min_by("origin", "p").alias("origin"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dim FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def scan_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.size("embedding").alias("dim"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND embedding IS NOT NULL")
def scan_vectors_by_id(spark, d) -> DataFrame:
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").filter("embedding IS NOT NULL").join(ids, "vec_id", "left_semi").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def sink_delete(spark, d) -> DataFrame:
    gone = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id", "label")


@query("""WITH w AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '')) AS w FROM part),
h AS (SELECT p_partkey, sha256(w) AS h FROM w),
c AS (SELECT p_partkey, (('0x' || substr(h, 1, 8))::UBIGINT % 32)::INT AS i, (CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (1.0::DOUBLE + ('0x' || substr(h, 11, 2))::UBIGINT / 255.0::DOUBLE) AS x FROM h),
s AS (SELECT p_partkey, i, sum(x) AS x FROM c GROUP BY ALL), n AS (SELECT p_partkey, sqrt(sum(x * x)) AS size FROM s GROUP BY 1)
SELECT p_partkey, i, round(x / size, 6) AS x FROM s JOIN n USING (p_partkey) WHERE abs(x / size) > 1e-9""")
def hash_embedding(spark, d) -> DataFrame:
    made = vectors.hash_embedding(table(spark, d, "part"), "p_partkey", "p_name", 32)
    return made.select("p_partkey", F.posexplode("vector").alias("i", "x")).filter("abs(x) > 1e-9").withColumn("x", F.round("x", 6))


@query(f"{V} SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE b.vec_id = (SELECT min(vec_id) FROM v)")
def cosine(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings")
    first = base.agg(F.min_by(F.struct(F.col("vec_id").alias("other"), F.col("embedding").alias("e2")), "vec_id").alias("x")).select("x.*")
    return base.join(F.broadcast(first)).select("vec_id", "other", F.round(vectors.cosine(F.col("embedding"), F.col("e2")), 6).alias("score"))


@query(f"{LINKS} SELECT asg.id, asg.cluster_id, v.label AS payload FROM asg JOIN v ON v.vec_id = asg.id")
def enrich_assignments(spark, d) -> DataFrame:
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("payload"))
    return vectors.number_clusters(_labelled(spark, d)).select("id", "cluster_id").join(base, "id", "left")


@query(f"{LINKS} SELECT cluster_id, CASE WHEN count(DISTINCT block) = 1 THEN min(block)::VARCHAR ELSE 'MIXED' END AS cluster_type FROM asg GROUP BY 1")
def cluster_type(spark, d) -> DataFrame:
    assigned = vectors.number_clusters(_labelled(spark, d)).groupBy("cluster_id").agg(F.min("block").alias("x"), F.max("block").alias("y"))
    return assigned.select("cluster_id", F.when(F.col("x") == F.col("y"), F.col("x").cast("string")).otherwise("MIXED").alias("cluster_type"))


@query(f"{LINKS}, k AS (SELECT id, min(id) OVER (PARTITION BY cluster_id) AS canonical_id, cluster_id FROM asg) SELECT id, CASE WHEN cluster_id = 'noise' THEN id ELSE canonical_id END AS canonical_id FROM k")
def align_canonical(spark, d) -> DataFrame:
    """Every member maps to its cluster's first existing member; noise maps to itself."""
    assigned = vectors.number_clusters(_labelled(spark, d))
    first = F.min("id").over(Window.partitionBy("cluster_id"))
    return assigned.select("id", F.when(F.col("cluster_id") == "noise", F.col("id")).otherwise(first).alias("canonical_id"))
