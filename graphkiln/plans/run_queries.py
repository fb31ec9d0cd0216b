"""Queries of resumed runs, of scored answers and of fetched pages and posts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.functions.cut import shared_folder
from graphkiln.operators import evaluation, reports, vectors
from graphkiln.operators.runs import Runs
from graphkiln.plans.vector_queries import LINKS, PAIRS, THRESHOLD
from graphkiln.sources import star, web
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


@query(f"""WITH {star.NODES_SQL}, n AS (SELECT count(*) AS c FROM nodes), e AS (SELECT count(*) AS c FROM orders)
SELECT 1::BIGINT AS attempt, 'nodes' AS step, 'completed' AS status, c AS n FROM n UNION ALL SELECT 1, 'orders', 'failed', NULL UNION ALL SELECT 1, NULL, 'failed', NULL
UNION ALL SELECT 2, 'nodes', 'skipped', c FROM n UNION ALL SELECT 2, 'orders', 'completed', c FROM e UNION ALL SELECT 2, NULL, 'completed', NULL""")
def run_resumed(spark, d) -> DataFrame:
    """The events of a run whose second step fails, and of the run that goes on from there."""
    runs, attempts = Runs(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"), []

    def orders(spark, made) -> DataFrame:
        if len(attempts) == 1:
            raise ConnectionError("planted")
        return table(spark, d, "orders")

    steps = [("nodes", lambda spark, made: star.nodes(spark, d)), ("orders", orders)]
    for k in ("1", "2"):
        attempts.append(k)
        try:
            runs.run(steps, run=k)
        except ConnectionError:
            pass
    return runs.events().filter("status <> 'running'").select(F.col("run").cast("long").alias("attempt"), "step", "status", F.col("rows").alias("n"))


def recall(question: str, answer: str, contexts: list[str], reference: str) -> float | None:
    """The share of the reference's words that the contexts hold."""
    words = set(reference.split(" "))
    return round(len(words & {w for c in contexts for w in c.split(" ")}) / len(words), 6)


def length(question: str, answer: str, contexts: list[str], reference: str) -> float | None:
    return float("nan") if answer.startswith("view") else float(len(answer))


ANSWERS = "a AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS state, event_type AS answer, event_type || ' of ' || user_id AS c, 'a ' || event_type || ' of ' || (user_id % 10) AS reference FROM events)"
METRICS = "CASE WHEN state = 'ok' THEN round(len(list_intersect(string_split(reference, ' '), string_split(c, ' '))) / len(list_distinct(string_split(reference, ' '))), 6) END AS context_recall, CASE WHEN state = 'ok' AND NOT starts_with(answer, 'view') THEN length(answer)::DOUBLE END AS size"


@query(f"""WITH {ANSWERS} SELECT id, CASE WHEN id % 4 = 0 THEN 1.0::DOUBLE ELSE context_recall END AS context_recall, CASE WHEN id % 4 = 0 THEN 1.0::DOUBLE ELSE size END AS size,
CASE WHEN id % 4 = 0 THEN 'scored' WHEN state <> 'ok' THEN 'skipped' WHEN size IS NULL THEN 'partial' ELSE 'scored' END AS status,
CASE WHEN id % 4 = 0 THEN NULL WHEN state <> 'ok' THEN 'generation row failed' WHEN size IS NULL THEN 'invalid metrics: size' END AS error FROM (SELECT *, {METRICS} FROM a)""")
def metric_scoring(spark, d) -> DataFrame:
    """Every event's answer scored by two metrics; every fourth was scored before and stays so."""
    events, kind = table(spark, d, "events"), F.col("event_type")
    user = F.col("user_id").cast("string")
    rows = events.select(
        F.col("event_id").alias("id"), F.when(kind == "error", "error").otherwise("ok").alias("status"), F.lit("").alias("error"), F.lit("what?").alias("question"), kind.alias("answer"),
        F.array(F.concat(kind, F.lit(" of "), user)).alias("contexts"), F.concat(F.lit("a "), kind, F.lit(" of "), (F.col("user_id") % 10).cast("string")).alias("reference"),
    )
    metrics = F.array(F.lit("context_recall"), F.lit("size"))
    done = events.filter("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.lit(1.0).alias("context_recall"), F.lit(1.0).alias("size"), F.lit("scored").alias("status"), F.lit(None).cast("string").alias("error"), metrics.alias("valid"), F.slice(metrics, 1, 0).alias("invalid"))
    return evaluation.score_answers(rows, {"context_recall": recall, "size": length}, done).drop("valid", "invalid")


@query("SELECT url, CASE WHEN length(url) % 5 <> 0 THEN length(h) END AS n_chars, CASE WHEN length(url) % 5 = 0 THEN 'HTTP 404' WHEN h IS NULL THEN 'empty' END AS error FROM (SELECT url, arg_min(html, html) AS h FROM pages WHERE url IS NOT NULL AND length(url) % 3 <> 0 GROUP BY url)")
def scan_web(spark, d) -> DataFrame:
    """Every address that wasn't visited before, with its page or the reason why there is none."""
    pages = table(spark, d, "pages")
    responses = pages.select("url", F.when(F.length("url") % 5 == 0, 404).otherwise(200).alias("status"), "html")
    found = web.fetched(responses, pages.filter(F.length("url") % 3 == 0).select("url"))
    return found.select("url", F.length("html").cast("long").alias("n_chars"), "error")


def _posts(spark, d) -> DataFrame:
    """Documents as the posts of pages of a hundred, their languages as categories and their sources as tags."""
    docs = table(spark, d, "documents")
    term = lambda c: F.array(F.struct(F.length(c).cast("long").alias("id"), F.col(c).alias("name")))
    post = F.struct(
        F.col("doc_id").alias("id"), F.struct(F.col("source").alias("rendered")).alias("title"), F.struct(F.col("text").alias("rendered")).alias("content"),
        F.struct(F.array(term("lang"), term("source")).alias("wp:term")).alias("_embedded"),
    )
    paged = docs.groupBy((F.floor(F.col("doc_id") / 100) + 1).alias("page")).agg(F.to_json(F.collect_list(post)).alias("body"))
    return web.posts(paged.select("page", F.lit(200).alias("status"), F.lit(None).cast("int").alias("total_pages"), "body"))


@query("SELECT doc_id // 100 + 1 AS page, doc_id AS id, source AS title, length(text) AS n_chars FROM documents")
def scan_wp_api(spark, d) -> DataFrame:
    return _posts(spark, d).select("page", "id", "title", F.length("html").cast("long").alias("n_chars"))


@query("SELECT 'categories' AS kind, length(lang) AS id, max(lang) AS name, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY length(lang) UNION ALL SELECT 'tags', length(source), max(source), count(*) FROM documents WHERE source IS NOT NULL GROUP BY length(source)")
def post_terms(spark, d) -> DataFrame:
    return web.term_counts(_posts(spark, d))


@query(f"""{PAIRS}, k AS (SELECT doc_id AS id, source, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]{{9,}}'))) AS words FROM documents)
SELECT a, b, list_sort(list_intersect(x.words, y.words)) AS shared FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE len(list_intersect(x.words, y.words)) > 0 AND x.source IS DISTINCT FROM y.source""")
def keyphrase_overlap(spark, d) -> DataFrame:
    """The long words that the documents of similar vectors share; documents of one source are linked already."""
    similar = vectors.threshold_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", THRESHOLD).select("a", "b")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), 0))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("a"), "source", words.alias("keyphrases"))
    sources = docs.select("a", "source")
    known = similar.join(sources, "a").join(sources.toDF("b", "other"), "b").filter("source <=> other").select("a", "b")
    return evaluation.shared_keyphrases(similar, docs.select(F.col("a").alias("id"), "keyphrases"), known)


@query(f"""{LINKS}, x AS (SELECT asg.cluster_id, asg.id, d.source AS name, d.lang AS label, row_number() OVER (PARTITION BY asg.cluster_id ORDER BY coalesce(d.source, ''), asg.id) AS k FROM asg LEFT JOIN documents d ON d.doc_id = asg.id WHERE asg.cluster_id <> 'noise')
SELECT cluster_id, count(*) AS size, count(DISTINCT label) AS n_labels, list(id ORDER BY k) FILTER (k <= 3) AS members FROM x GROUP BY cluster_id""")
def cluster_review(spark, d) -> DataFrame:
    vecs = table(spark, d, "embeddings")
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("label"))
    nodes = vecs.select(F.col("vec_id").alias("id"), F.col("label").alias("block"))
    pairs = vectors.threshold_pairs(vecs, "vec_id", "embedding", "label", THRESHOLD)
    labelled = vectors.components(pairs.select("a", "b"), nodes.select("id")).join(nodes, "id")
    return reports.cluster_review(vectors.number_clusters(labelled), items, 3)


@query("SELECT conv_id AS id, min(q) AS question, list_sort(list(role || ': ' || status || ': ' || n)) AS answers FROM (SELECT conv_id, coalesce(role, 'none') AS role, min(text) AS q, CASE WHEN count(*) > 1 THEN 'ok' ELSE 'short' END AS status, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def answer_review(spark, d) -> DataFrame:
    """Conversations as questions, their roles as modes, the number of messages as answers."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id"), F.coalesce("role", F.lit("none")).alias("mode")).agg(F.min("text").alias("question"), F.count("*").alias("n"))
    rows = rows.select("id", "mode", "question", F.when(F.col("n") > 1, "ok").otherwise("short").alias("status"), F.col("n").cast("string").alias("answer"))
    made = reports.answer_review(rows)
    return made.withColumn("answers", F.transform("answers", lambda x: F.concat_ws(": ", x["mode"], x["status"], x["answer"])))
