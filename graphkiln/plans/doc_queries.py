"""Queries of documents, chunks and corpus preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.functions.cut import shared_folder
from graphkiln.operators import documents
from graphkiln.sources.star import table

QUERIES: dict = {}
ORACLES: dict = {}

RULES = {"en": [" the ", " of "], "fr": [" les ", " des "], "de": [" und ", " der "], "es": [" los ", " que "]}
QUOTAS = {"en": 30, "fr": 20, "de": 20, "es": 10}
TARGET = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HIT = " OR ".join
LABELS = "list_filter([" + ", ".join("CASE WHEN " + HIT(f"contains(' ' || text || ' ', '{k}')" for k in ks) + f" THEN '{label}' END" for label, ks in RULES.items()) + "], lambda x: x IS NOT NULL)"
POINTS = {g: " + ".join(f"(CASE WHEN contains(text, '{k}') THEN 5 ELSE 0 END)" for k in ks) for g, ks in RULES.items()}
WORDS = r"len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> ''))"
SCORED = f"WITH s AS (SELECT doc_id, text, lang, {WORDS} AS words, {LABELS} AS labels, greatest({', '.join(POINTS.values())}) AS best FROM documents), c AS (SELECT *, 8.0::DOUBLE * len(labels) + best + least(words / 20.0::DOUBLE, 20.0) AS score, sha1(substr(text, 1, 1500)) AS fp FROM s)"


def _candidates(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.col("text")
    points = documents.keyword_counts(text, RULES)
    rows = docs.select("doc_id", "text", "lang", documents.word_count(text).alias("words"), documents.label_hits(text, RULES).alias("labels"), F.array_max(F.map_values(points)).alias("best"))
    no = F.lit(False)
    score = documents.doc_score(F.size("labels"), F.col("best"), F.lit(0), F.lit(0), F.col("words"), no, no, no, F.lit(0))
    return rows.select("*", score.cast("double").alias("score"), F.sha1(F.substring("text", 1, 1500).cast("binary")).alias("fp"))


@query(f"SELECT doc_id, {LABELS} AS labels FROM documents")
def match_labels(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.label_hits(F.col("text"), RULES).alias("labels"))


@query("SELECT doc_id, " + ", ".join(f"{x} AS points_{g}" for g, x in POINTS.items()) + " FROM documents")
def group_scores(spark, d) -> DataFrame:
    points = documents.keyword_counts(F.col("text"), RULES)
    return table(spark, d, "documents").select("doc_id", *[F.element_at(points, g).alias(f"points_{g}") for g in RULES])


@query(f"{SCORED} SELECT doc_id, round(score, 6) AS score FROM c")
def doc_score(spark, d) -> DataFrame:
    return _candidates(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{SCORED} SELECT doc_id, CASE WHEN words = 0 THEN 'empty' WHEN words < 80 THEN 'too_short' WHEN len(labels) = 0 THEN 'no_ontology_match' END AS reason FROM c")
def reject_reason(spark, d) -> DataFrame:
    reason = documents.reject_reason(F.col("words"), documents.metadata_leak(F.col("text")), F.size("labels"))
    return _candidates(spark, d).select("doc_id", reason.alias("reason"))


@query(f"{SCORED}, r AS (SELECT lang, CASE WHEN words = 0 THEN 'empty' WHEN words < 80 THEN 'too_short' WHEN len(labels) = 0 THEN 'no_ontology_match' ELSE 'accepted' END AS reason, length(text) AS chars FROM c) SELECT lang, reason, count(*) AS n, max(chars) AS max_chars FROM r GROUP BY ALL")
def corpus_summary(spark, d) -> DataFrame:
    reason = documents.reject_reason(F.col("words"), documents.metadata_leak(F.col("text")), F.size("labels"))
    rows = _candidates(spark, d).select("lang", F.coalesce(reason, F.lit("accepted")).alias("reason"), F.length("text").cast("long").alias("chars"))
    return rows.groupBy("lang", "reason").agg(F.count("*").alias("n"), F.max("chars").alias("max_chars"))


QUOTA_SQL = " ".join(f"WHEN lang = '{g}' THEN {n}" for g, n in QUOTAS.items())
CHOSEN = f"""{SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY score DESC, words DESC, doc_id) AS k FROM c), u AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, words DESC, doc_id) <= CASE {QUOTA_SQL} ELSE 0 END AS q FROM o WHERE k = 1),
a AS (SELECT doc_id AS id, lang AS grp, CASE WHEN q THEN 'quota' ELSE 'fill' END AS reason, score, words, row_number() OVER (ORDER BY NOT q, score DESC, words DESC, doc_id)::INTEGER AS place FROM u)"""


def _chosen(spark, d) -> DataFrame:
    c = _candidates(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "score", "words", F.col("fp").alias("fingerprint"))
    return documents.quota_select(c, QUOTAS, TARGET)


@query(f"{CHOSEN} SELECT id, grp, reason, place FROM a WHERE place <= {TARGET}")
def quota_select(spark, d) -> DataFrame:
    return _chosen(spark, d).select("id", "grp", "reason", "place")


@query(f"{CHOSEN} SELECT lpad(place::VARCHAR, 3, '0') || '_' || grp AS name, printf('%.2f', score) AS score FROM a WHERE place <= {TARGET}")
def output_naming(spark, d) -> DataFrame:
    return _chosen(spark, d).select(F.concat_ws("_", F.lpad(F.col("place").cast("string"), 3, "0"), "grp").alias("name"), F.format_string("%.2f", "score").alias("score"))


@query(f"{CHOSEN} SELECT id, grp, reason, place, round(score, 6) AS score FROM a WHERE place <= {TARGET}")
def sink_manifest(spark, d) -> DataFrame:
    """The manifest of the chosen documents, written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    _chosen(spark, d).select("id", "grp", "reason", "place", F.round("score", 6).alias("score")).write.json(path)
    return spark.read.schema("id bigint, grp string, reason string, place int, score double").json(path)


@query("SELECT doc_id, contains(text, '**URL**:') OR contains(text, '**Source**:') OR regexp_matches(text, '(?im)^##\\s+metadata\\s*$') AS leak FROM documents")
def has_metadata_leak(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.metadata_leak(F.col("text")).alias("leak"))


@query("SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, lang AS value FROM documents")
def strip_metadata(spark, d) -> DataFrame:
    made = F.concat(F.lit("## Metadata\n\n- **Lang**: "), "lang", F.lit("\n- **Key**: x\n\n"), "text")
    rows = table(spark, d, "documents").select("doc_id", "text", made.alias("m"))
    return rows.select("doc_id", documents.strip_metadata(F.col("m")).alias("body"), F.try_element_at(documents.parse_metadata(F.col("m")), F.lit("Lang")).alias("value"))


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS l FROM documents) SELECT doc_id, k::INTEGER AS start, l[k + 1 : k + 100] AS tokens FROM (SELECT doc_id, l, unnest(range(0, len(l), 80)) AS k FROM w)")
def token_windows(spark, d) -> DataFrame:
    return documents.token_windows(table(spark, d, "documents"), "doc_id", "text", 100, 20)


@query(None)
def html_to_markdown(spark, d) -> DataFrame:
    return documents.to_markdown(table(spark, d, "pages"))


@query(None)
def chunk_document(spark, d) -> DataFrame:
    return documents.chunks(table(spark, d, "documents"))


@query(None)
def chunk_document_sentence(spark, d) -> DataFrame:
    return documents.chunks(table(spark, d, "documents"), strategy="sentence")


@query(None)
def greedy_doc_cluster(spark, d) -> DataFrame:
    return documents.cluster_by_name(table(spark, d, "part").select(F.regexp_replace("p_type", " ", "_").alias("name")).distinct())


@query("SELECT sha1(text) AS digest, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).filter("n > 1")


@query(r"SELECT conv_id, turn, regexp_split_to_array(text, '[;:]\s+|\n+') AS clauses FROM conversations")
def clauses(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.split("text", r"[;:]\s+|\n+").alias("clauses"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def md_title(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query(r"SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, 'href=\"([^\"?#]+)', 1), lambda x: starts_with(x, '/'))))::INTEGER AS n_links FROM pages")
def related_links(spark, d) -> DataFrame:
    links = F.filter(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"?#]+)'), F.lit(1))), lambda x: x.startswith("/"))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n_links"))


@query(r"WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT item_id, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w)) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def query_terms(spark, d) -> DataFrame:
    """Two-word terms of the questions."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), "")
    rows = table(spark, d, "benchmark").select(words.alias("w")).filter("size(w) > 1")
    grams = rows.select(F.explode(F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text)::INTEGER AS n, sha1(text) AS digest FROM documents")
def scan_markdown(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.sha1(F.col("text").cast("binary")).alias("digest"))


@query("SELECT lang, count(DISTINCT md5(lower(text))) AS n_starts, count(*) AS n FROM documents GROUP BY lang")
def document_starts(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.countDistinct(F.md5(F.lower("text").cast("binary"))).alias("n_starts"), F.count("*").alias("n"))

