"""Queries of text functions over names, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.functions import text as t
from graphkiln.operators import resolution
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


COLLAPSE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
WHOLE = "WITH f AS (SELECT doc_id, text AS line FROM documents)"
FOLD = "strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))"


def c(x: str) -> str:
    return COLLAPSE.format(x=x)


def fold(x: str) -> str:
    return FOLD.format(x=x)


SEARCH = c(fold(f"lower({c('line')})"))
QUERY = c(rf"regexp_replace(regexp_replace({SEARCH}, '[_\-/\\.]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")
MATCH = r"trim(regexp_replace(replace(lower(regexp_replace(" + fold("line") + r", '[^\x00-\x7F]', '', 'g')), '_', ' '), '[^a-z0-9@./:+\-]+', ' ', 'g'))"


def texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("line"))


@query(f"{WHOLE} SELECT doc_id, {c('line')} AS normal FROM f")
def normalize_text(spark, d) -> DataFrame:
    return texts(spark, d).select("doc_id", t.normalize_text(F.col("line")).alias("normal"))


@query(f"{WHOLE} SELECT doc_id, {fold('line')} AS plain FROM f")
def strip_accents(spark, d) -> DataFrame:
    return texts(spark, d).select("doc_id", t.strip_accents(F.col("line")).alias("plain"))


@query(f"{WHOLE} SELECT doc_id, {SEARCH} AS stored, {QUERY} AS asked FROM f")
def normalize_search_text(spark, d) -> DataFrame:
    return texts(spark, d).select("doc_id", t.search_text(F.col("line")).alias("stored"), t.query_text(F.col("line")).alias("asked"))


@query(f"{WHOLE} SELECT doc_id, {MATCH} AS matched FROM f")
def normalize_for_match(spark, d) -> DataFrame:
    return texts(spark, d).select("doc_id", t.match_text(F.col("line")).alias("matched"))


@query(rf"WITH f AS (SELECT p_partkey, p_name AS line FROM part), k AS (SELECT p_partkey, regexp_replace(rtrim(substr(trim(regexp_replace(regexp_replace(replace(lower({fold('line')}), ' ', '_'), '[^a-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_'), 1, 200), '_'), 'x^', '') AS k FROM f) SELECT p_partkey, CASE WHEN k = '' THEN 'node_unknown' ELSE 'node_' || k END AS canonical_id FROM k")
def build_canonical_id(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.canonical_id(F.col("p_name")).alias("canonical_id"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'PERSON' WHEN p_size > 10 THEN 'ORGANIZATION' ELSE upper(p_brand) END AS primary_type FROM part")
def block_primary_type(spark, d) -> DataFrame:
    labels = F.when(F.col("p_size") > 25, F.array("p_brand", F.lit("Person"))).when(F.col("p_size") > 10, F.array("p_brand", F.lit("Organization"))).otherwise(F.array("p_brand"))
    return table(spark, d, "part").select("p_partkey", t.primary_type(labels).alias("primary_type"))


@query(f"WITH {star.NODES_SQL} SELECT id, CASE WHEN list_contains(list_transform(labels, lambda x: upper(x)), 'PERSON') THEN 'PERSON' WHEN list_contains(list_transform(labels, lambda x: upper(x)), 'ORGANIZATION') THEN 'ORGANIZATION' ELSE coalesce(upper(labels[1]), 'UNKNOWN') END AS primary_type FROM nodes")
def primary_type(spark, d) -> DataFrame:
    return star.nodes(spark, d).select("id", t.primary_type(F.col("labels")).alias("primary_type"))


@query("SELECT p_partkey, CASE WHEN p_brand LIKE '%1%' THEN 'a' WHEN p_type LIKE '%BRASS%' THEN 'b' ELSE 'unknown' END AS block FROM part")
def block_by_strategy(spark, d) -> DataFrame:
    """The first label that the strategy maps decides."""
    labels = F.array(F.when(F.col("p_brand").contains("1"), "one"), F.when(F.col("p_type").contains("BRASS"), "brass"))
    mapping = spark.range(1).select(F.explode(F.map_from_arrays(F.array(F.lit("one"), F.lit("brass")), F.array(F.lit("a"), F.lit("b")))).alias("label", "block"))
    tagged = table(spark, d, "part").select("p_partkey", F.posexplode_outer(labels).alias("pos", "label")).join(F.broadcast(mapping), "label", "left")
    first = tagged.filter("block IS NOT NULL").groupBy("p_partkey").agg(F.min_by("block", "pos").alias("block"))
    return table(spark, d, "part").select("p_partkey").join(first, "p_partkey", "left").select("p_partkey", F.coalesce("block", F.lit("unknown")).alias("block"))


@query("SELECT list_sort([p_brand, p_type]) AS labels, count(*) AS n FROM part GROUP BY 1")
def unique_label_combos(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.array_sort(F.array("p_brand", "p_type")).alias("labels")).agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, trim(regexp_replace(trim('TS. ' || p_name), '^(GS\.TSKH|GS\.TS|PGS\.TS|TS|ThS|CN|KS)\.?\s+', '', 'i')) AS person, p_name AS other FROM part")
def normalize_person_name(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.person_name(F.concat(F.lit("TS. "), "p_name")).alias("person"), t.person_name(F.col("p_name")).alias("other"))


@query("SELECT p_partkey, p_name AS embedding_text FROM part")
def embedding_text(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.embedding_text(F.concat(F.lit("ThS "), "p_name"), F.array(F.lit("Person"))).alias("embedding_text"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(p_name) THEN [p_name] ELSE [p_name, p_brand] END AS aliases FROM part")
def normalize_aliases(spark, d) -> DataFrame:
    raw = F.array("p_name", F.concat(F.lit(" "), F.upper("p_name")), F.lit(" "), "p_brand", F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", t.aliases(raw).alias("aliases"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9]') THEN 'L_' || x ELSE x END AS label FROM (SELECT p_partkey, regexp_replace(p_size || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS x FROM part)")
def sanitize_label(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.sanitize_label(F.concat(F.col("p_size").cast("string"), "p_brand")).alias("label"))


@query(r"WITH x AS (SELECT p_partkey, p_brand || '_' || p_partkey || '/' || p_size AS x FROM part), y AS (SELECT *, trim(regexp_replace(x, '[_\-/\\.]+', ' ', 'g')) AS s FROM x), z AS (SELECT p_partkey, list_concat([x, s], list_filter(string_split(s, ' '), lambda p: length(p) >= 2)) AS l FROM y) SELECT p_partkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS variants FROM z")
def identifier_variants(spark, d) -> DataFrame:
    name = F.concat_ws("", "p_brand", F.lit("_"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(t.identifier_variants(name), "|").alias("variants"))


@query("SELECT n_nationkey, lower(n_name) AS search_name, lower(n_name) || ' ' || lower(r_name) AS search_text FROM nation JOIN region ON n_regionkey = r_regionkey")
def search_properties_node(spark, d) -> DataFrame:
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = F.array_distinct(F.transform(F.array("n_name", "r_name", "n_name"), t.search_text))
    return joined.select("n_nationkey", t.search_text(F.col("n_name")).alias("search_name"), F.array_join(parts, " ").alias("search_text"))


@query("SELECT event_type AS type, lower(event_type) AS search_type, count(*) AS n FROM events GROUP BY event_type")
def search_properties_rel(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n")).select("type", t.search_text(F.col("type")).alias("search_type"), "n")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::INTEGER AS n_tokens FROM documents")
def count_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.count_tokens(F.col("text")).alias("n_tokens"))


@query(rf"{WHOLE} SELECT doc_id, sha1(substr({MATCH}, 1, 1500)) AS fingerprint FROM f")
def fingerprint(spark, d) -> DataFrame:
    return texts(spark, d).select("doc_id", t.fingerprint(F.col("line")).alias("fingerprint"))


@query(r"SELECT page_id, CASE WHEN s = '' THEN 'page' ELSE s END || '_' || substr(sha1(url), 1, 10) || '.md' AS filename FROM (SELECT page_id, url, substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\-]+', '_', 'g'), '_'), 1, 120) AS s FROM pages)")
def url_filename(spark, d) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", t.url_filename(title, F.col("url")).alias("filename"))


#: Parts of addresses that a crawl leaves out.
SKIPPED = ("/wp-admin/", "/wp-content/", "/wp-includes/", "/feed/", "/rss/", "/xmlrpc.php", ".jpg", ".jpeg", ".png", ".gif", ".pdf", ".zip", "/tag/", "/category/", "/author/")


@query(f"SELECT page_id, url FROM pages WHERE NOT ({' OR '.join(f'contains(url, {chr(39)}{s}{chr(39)})' for s in SKIPPED)})")
def filter_url(spark, d) -> DataFrame:
    return table(spark, d, "pages").filter(crawled(F.col("url"))).select("page_id", "url")


def crawled(url):
    """Whether a crawl takes an address."""
    found = F.lit(False)
    for s in SKIPPED:
        found = found | url.contains(s)
    return ~found


@query(r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(x, '\[([^\]]+)\]', 1))) AS cited, len(list_distinct(regexp_extract_all(x, '\[([^\]]+)\]', 1)))::INTEGER AS n FROM (SELECT doc_id, '[1] ' || text || ' [b] [1]' AS x FROM documents)")
def extract_citations(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", t.citations(F.concat(F.lit("[1] "), "text", F.lit(" [b] [1]"))).alias("found"))
    return rows.select("doc_id", F.array_sort("found").alias("cited"), F.size("found").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]')) AS n_marked FROM documents GROUP BY lang")
def looks_vietnamese(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(t.looks_vietnamese(F.col("text"))).alias("n_marked"))


@query(f"{WHOLE} SELECT doc_id, (' ' || {QUERY}) LIKE '% no%' AS negative FROM f")
def looks_negative(spark, d) -> DataFrame:
    return texts(spark, d).select("doc_id", t.looks_negative(F.col("line")).alias("negative"))


@query(r"SELECT p_partkey, trim(regexp_replace(replace(regexp_replace('Entity#' || p_partkey || '; ' || p_name || ' #2', 'Entity#[0-9]+|#[0-9]+', '', 'g'), ';', ' '), '\s+', ' ', 'g')) AS text FROM part")
def relational_query_to_text(spark, d) -> DataFrame:
    asked = F.concat(F.lit("Entity#"), F.col("p_partkey").cast("string"), F.lit("; "), "p_name", F.lit(" #2"))
    return table(spark, d, "part").select("p_partkey", t.relational_text(asked).alias("text"))


@query("SELECT a.page_id AS a, b.page_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM (SELECT page_id, list_distinct(list_filter(string_split(regexp_replace(lower(url), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM pages) a JOIN (SELECT page_id, list_distinct(list_filter(string_split(regexp_replace(lower(url), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM pages) b ON b.page_id = a.page_id + 1")
def jaccard_filename(spark, d) -> DataFrame:
    words = F.array_distinct(F.array_remove(F.split(F.regexp_replace(F.lower("url"), "[^a-z]+", " "), " "), ""))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("a"), words.alias("w"))
    other = pages.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("w").alias("v"))
    share = F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")).cast("double")
    return pages.join(other, "a").select("a", "b", F.round(share, 6).alias("jaccard"))


ALIASES = "list_distinct(list_filter(string_split(regexp_replace(lower(c_name || ' ' || c_mktsegment || ' of ' || c_nationkey), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"WITH a AS (SELECT c_nationkey AS block, c_custkey, {ALIASES} AS w FROM customer) SELECT a.block, a.c_custkey AS a, b.c_custkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM a JOIN a b ON a.block = b.block AND a.c_custkey < b.c_custkey WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.5")
def alias_jaccard(spark, d) -> DataFrame:
    """Pairs of a block that share at least half of their aliases."""
    words = F.split(F.regexp_replace(F.lower(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" of "), F.col("c_nationkey").cast("string"))), "[^a-z0-9]+", " "), " ")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("key"), F.array_distinct(F.array_remove(words, "")).alias("words"))
    return resolution.jaccard_pairs(rows, 0.5)
