"""Queries of evaluation, evidence packing, runs and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.operators import evaluation as ev
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


JUDGED = "WITH j AS (SELECT event_type AS predicate, CASE event_id % 4 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'not_enough_info' ELSE 'supported' END AS label, (user_id % 120) / 100.0::DOUBLE AS confidence, event_id % 7 <> 0 AS valid FROM events)"
WILSON = "(p + {z}*{z} / (2 * n) {s} {z} * sqrt(p * (1 - p) / n + {z}*{z} / (4 * n * n))) / (1 + {z}*{z} / n)"


def _judged(spark, d) -> DataFrame:
    k = F.col("event_id") % 4
    label = F.when(k == 0, "contradicted").when(k == 1, "not_enough_info").otherwise("supported")
    return table(spark, d, "events").select(F.col("event_type").alias("predicate"), label.alias("label"), (F.col("user_id") % 120 / F.lit(100.0)).alias("confidence"), (F.col("event_id") % 7 != 0).alias("valid"))


@query(f"""{JUDGED}, a AS (SELECT predicate, count(*) AS total, count(*) FILTER (valid) AS valid_total, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND label = 'supported') AS supported, count(*) FILTER (valid AND label = 'contradicted') AS contradicted, count(*) FILTER (valid AND label = 'not_enough_info') AS not_enough_info, avg(confidence) FILTER (valid AND confidence BETWEEN 0 AND 1) AS mean_confidence FROM j GROUP BY ROLLUP (predicate)),
b AS (SELECT *, supported / valid_total::DOUBLE AS p, valid_total::DOUBLE AS n FROM a)
SELECT predicate, total, valid_total, invalid, supported, contradicted, not_enough_info, round(mean_confidence, 6) AS mean_confidence, round(p, 9) AS supported_rate, round(greatest(0.0, {WILSON.format(z=ev.Z, s='-')}), 9) AS low, round(least(1.0, {WILSON.format(z=ev.Z, s='+')}), 9) AS high FROM b""")
def triplet_summary(spark, d) -> DataFrame:
    out = ev.triplet_summary(_judged(spark, d))
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 6), **{c: F.round(c, 9) for c in ("supported_rate", "low", "high")}})


@query(f"{JUDGED}, b AS (SELECT predicate, count(*) FILTER (label = 'supported') AS s, count(*) AS n FROM j WHERE valid GROUP BY 1) SELECT round(avg(s / n::DOUBLE), 9) AS macro, round(sum(s) / sum(n)::DOUBLE, 9) AS micro FROM b")
def triplet_rates(spark, d) -> DataFrame:
    return ev.macro_rate(_judged(spark, d)).select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"))


@query(f"SELECT g.k AS k, round(greatest(0.0, {WILSON.format(z=ev.Z, s='-')}), 9) AS low, round(least(1.0, {WILSON.format(z=ev.Z, s='+')}), 9) AS high FROM (SELECT event_type AS k, count(*)::DOUBLE AS n, count(*) FILTER (event_id % 3 = 0) / count(*)::DOUBLE AS p FROM events GROUP BY 1) g")
def wilson_ci(spark, d) -> DataFrame:
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.count_if(F.col("event_id") % 3 == 0).alias("s"), F.count("*").alias("n"))
    low, high = ev.wilson(F.col("s"), F.col("n"))
    return by.select("k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


SCORED = "WITH s AS (SELECT event_type AS mode, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'scored' WHEN 2 THEN 'partial' WHEN 3 THEN 'error' ELSE 'skipped' END AS status, CASE WHEN event_id % 3 <> 0 THEN value END AS m1, CASE WHEN user_id % 2 = 0 THEN value * 2 END AS m2 FROM events)"


def _scored(spark, d) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, "ok").when(k == 1, "scored").when(k == 2, "partial").when(k == 3, "error").otherwise("skipped")
    m1 = F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(float("nan"))
    return table(spark, d, "events").select(F.col("event_type").alias("mode"), status.alias("status"), m1.alias("m1"), F.when(F.col("user_id") % 2 == 0, F.col("value") * 2).alias("m2"))


@query(f"{SCORED} SELECT mode, count(*) AS total, {', '.join(f'count(*) FILTER (status = {chr(39)}{x}{chr(39)}) AS n_{x}' for x in ('ok', 'scored', 'partial', 'error', 'skipped'))}, round(avg(m1), 6) AS avg_m1, round(avg(m2), 6) AS avg_m2 FROM s GROUP BY mode")
def score_summary(spark, d) -> DataFrame:
    return ev.score_summary(_scored(spark, d), "mode", ["m1", "m2"]).withColumns({c: F.round(c, 6) for c in ("avg_m1", "avg_m2")})


@query(f"{SCORED} SELECT CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN 'scored' WHEN m1 IS NOT NULL OR m2 IS NOT NULL THEN 'partial' ELSE 'error' END AS class, count(*) AS n FROM s GROUP BY 1")
def classify_scores(spark, d) -> DataFrame:
    return _scored(spark, d).groupBy(ev.classify_scores(["m1", "m2"]).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT item_id, mode FROM benchmark, (SELECT unnest(['direct', 'semantic_search', 'naive_grag', 'graph_search', 'hybrid']) AS mode)")
def samples_x_modes(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id").join(F.broadcast(_modes(spark)))


def _modes(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in ("direct", "semantic_search", "naive_grag", "graph_search", "hybrid")])).alias("mode"))


@query("""WITH p AS (SELECT item_id AS id, mode, CASE item_id % 4 WHEN 0 THEN 'Provider error: timeout' WHEN 1 THEN ' ' ELSE 'fine' END AS answer, item_id % 2 AS k, regexp_replace(text, '\\s+', ' ', 'g') AS q FROM benchmark, (SELECT unnest(['direct', 'semantic_search', 'naive_grag', 'graph_search', 'hybrid']) AS mode) WHERE mode <> 'hybrid')
SELECT b.item_id AS id, m.mode, p.answer, p.answer IS NULL OR trim(p.answer) = '' OR contains(lower(p.answer), 'provider error') AS retry
FROM benchmark b CROSS JOIN (SELECT unnest(['direct', 'semantic_search', 'naive_grag', 'graph_search', 'hybrid']) AS mode) m LEFT JOIN p ON p.id = b.item_id AND p.mode = m.mode""")
def retry_join(spark, d) -> DataFrame:
    samples = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    k = F.col("id") % 4
    prior = samples.join(F.broadcast(_modes(spark).filter("mode <> 'hybrid'"))).withColumn("answer", F.when(k == 0, "Provider error: timeout").when(k == 1, " ").otherwise("fine"))
    prior = prior.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")))
    return ev.retry_join(samples, _modes(spark), prior)


@query("SELECT predicate, n FROM (SELECT event_type AS predicate, event_id AS n, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 7")
def stratified_sample(spark, d) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_type").alias("predicate"), F.col("event_id").alias("n"))
    return ev.stratified_sample(events, "predicate", F.struct(F.md5(F.col("n").cast("string").cast("binary")), "n"), 7)


@query("SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
def random_sample(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id").limit(100)


@query("""WITH o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS item, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS c FROM documents),
f AS (SELECT *, max(CASE WHEN item > 1 AND (item > 12 OR c > 20000) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS over FROM o)
SELECT source, doc_id, item::INTEGER AS item, c::BIGINT AS chars_so_far FROM f WHERE over = 0""")
def pack_items(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return ev.pack(docs, "source", "doc_id", "text", 12, 20_000).select("source", "doc_id", "item", F.col("chars_so_far").cast("long").alias("chars_so_far"))


@query("SELECT conv_id, turn, sum(length(text)) OVER w AS chars_so_far, sum(length(text)) OVER w <= 2000 AS within FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def running_char_budget(spark, d) -> DataFrame:
    """How far each message fills its conversation's budget, and whether it fits."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(upto).alias("chars_so_far"))
    return rows.withColumn("within", F.col("chars_so_far") <= 2000)


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_chunks(spark, d) -> DataFrame:
    """The first of equal texts (by a digest), with its rank in the whole list."""
    docs = table(spark, d, "documents").select("doc_id", F.struct(F.xxhash64("text"), F.sha1(F.col("text").cast("binary"))).alias("digest"))
    ranked = ev.ranked(docs, "doc_id")
    return ranked.groupBy("digest").agg(F.min(F.struct("rank", "doc_id")).alias("x")).select("x.doc_id", "x.rank")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def rank_attach(spark, d) -> DataFrame:
    """Ranks in one order over all rows, by partitions of a range sort."""
    docs = table(spark, d, "documents").select("doc_id", (-F.col("n_chars")).alias("near"))
    return ev.ranked(docs, "near", "doc_id").select("doc_id", "rank")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE props <> '' GROUP BY ALL")
def dedupe_facts(spark, d) -> DataFrame:
    return ev.dedupe_first(table(spark, d, "events").filter("props <> ''"), F.struct("user_id", "event_type"), "event_id").select("user_id", "event_type", "event_id")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS question, count(*) AS n FROM conversations GROUP BY conv_id")
def last_user_message(spark, d) -> DataFrame:
    user = F.col("role") == "user"
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("question"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, list(text) OVER w AS facts FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def rolling_summary(spark, d) -> DataFrame:
    """What the messages before added: the state that a document cluster carries along."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-20, -1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.collect_list("text").over(before).alias("facts"))
    return rows.withColumn("facts", F.when(F.size("facts") > 0, F.col("facts")))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS chunk_index FROM conversations")
def chunk_index(spark, d) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).alias("chunk_index"))


@query("SELECT conv_id, turn, pos::INTEGER AS pos, tok FROM (SELECT conv_id, turn, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations WHERE role = 'assistant'))")
def stream_tokens(spark, d) -> DataFrame:
    kept = table(spark, d, "conversations").filter("role = 'assistant'")
    return kept.select("conv_id", "turn", F.posexplode(F.array_remove(F.split("text", " "), "")).alias("pos", "tok"))


@query("WITH q AS (SELECT source AS name, count(*)::BIGINT AS quota, row_number() OVER (ORDER BY source) AS pos FROM documents GROUP BY source), e AS (SELECT *, quota * 77 / (sum(quota) OVER ())::DOUBLE AS x FROM q), b AS (SELECT *, floor(x)::BIGINT AS base FROM e), r AS (SELECT *, 77 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY round(x - base, 12) DESC, pos) AS k FROM b) SELECT name, quota, base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS seats FROM r")
def sorted_quota(spark, d) -> DataFrame:
    quotas = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("quota")).withColumn("pos", F.row_number().over(Window.orderBy("name")))
    return ev.largest_remainder(quotas, 77)


@query("SELECT event_type, count(*) AS files, sum(value) > 0 AS positive, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def extraction_metrics(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("files"), (F.sum("value") > 0).alias("positive"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest([event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS term FROM events) GROUP BY term")
def tag_category_counts(spark, d) -> DataFrame:
    terms = F.array("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return table(spark, d, "events").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT event_id, left(event_type, 4) || CASE WHEN length(event_type) > 4 THEN '…' ELSE '' END AS short FROM events")
def truncate(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", shorten(F.col("event_type"), 4).alias("short"))


def shorten(text, size: int):
    return F.concat(F.left(text, F.lit(size)), F.when(F.length(text) > size, "…").otherwise(""))


@query("SELECT doc_id, left(text, 5000 // 3) || CASE WHEN length(text) > 5000 // 3 THEN '…' ELSE '' END AS capped FROM documents")
def cap_context(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", shorten(F.col("text"), 5000 // 3).alias("capped"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type)))[1:3] AS kept, greatest(0, len(list_distinct(list(event_type))) - 3)::INTEGER AS omitted FROM events GROUP BY user_id")
def compact_properties(spark, d) -> DataFrame:
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return kinds.select("user_id", F.slice("kinds", 1, 3).alias("kept"), F.greatest(F.lit(0), F.size("kinds") - 3).alias("omitted"))


@query("SELECT event_id, coalesce(trim(answer) = '' OR contains(lower(answer), 'provider error'), true) AS failed FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'Provider Error: ' || props ELSE props END AS answer FROM events)")
def result_failed(spark, d) -> DataFrame:
    answer = F.when(F.col("event_type") == "error", F.concat(F.lit("Provider Error: "), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", ev.failed(answer).alias("failed"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS cited, count(DISTINCT event_type) FILTER (event_type IN ('view', 'click')) AS n_valid, count(DISTINCT event_type) FILTER (event_type NOT IN ('view', 'click')) AS n_invalid FROM events GROUP BY user_id")
def citation_check(spark, d) -> DataFrame:
    known = F.array(F.lit("view"), F.lit("click"))
    cited = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("cited"))
    return cited.select("user_id", "cited", F.size(F.array_intersect("cited", known)).cast("long").alias("n_valid"), F.size(F.array_except("cited", known)).cast("long").alias("n_invalid"))


@query("SELECT conv_id, turn, i AS rel, (turn % 2 = 0 AND i < 2) AS kept FROM conversations, (SELECT unnest([0, 1, 2]) AS i) WHERE (turn % 2 = 0 AND i < 2) OR turn % 2 = 1")
def context_extract(spark, d) -> DataFrame:
    """Evidence of the initial stage if there is any, else all of it."""
    made = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("rel"), ((F.col("turn") % 2 == 0) & (i < 2)).alias("kept")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", made.alias("evidence"))
    first = F.filter("evidence", lambda x: x["kept"])
    chosen = rows.select("conv_id", "turn", F.explode(F.when(F.size(first) > 0, first).otherwise(F.col("evidence"))).alias("x"))
    return chosen.select("conv_id", "turn", "x.rel", "x.kept")


@query("SELECT conv_id, turn, greatest(0, 3 - (turn % 4))::BIGINT AS n_contexts FROM conversations")
def normalize_contexts(spark, d) -> DataFrame:
    stages = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i >= F.col("turn") % 4, "initial").otherwise("later"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.filter(stages, lambda x: x == "initial")).cast("long").alias("n_contexts"))


@query("SELECT mode, CASE WHEN mode IN ('semantic_search', 'hybrid') THEN 5 END AS chunk_k, CASE WHEN mode IN ('naive_grag', 'graph_search', 'hybrid') THEN 5 END AS graph_k FROM (SELECT unnest(['direct', 'semantic_search', 'naive_grag', 'graph_search', 'hybrid']) AS mode)")
def effective_budgets(spark, d) -> DataFrame:
    return _modes(spark).select("mode", F.when(F.col("mode").isin("semantic_search", "hybrid"), 5).alias("chunk_k"), F.when(F.col("mode").isin("naive_grag", "graph_search", "hybrid"), 5).alias("graph_k"))


@query("SELECT item_id, coalesce(nullif(CASE WHEN item_id % 3 = 0 THEN left(text, 12) END, ''), 'none') AS question, ['benchmark'] || CASE WHEN item_id % 2 = 0 THEN ['even'] ELSE [] END AS tags FROM benchmark")
def parse_sample(spark, d) -> DataFrame:
    asked = F.coalesce(F.nullif(F.when(F.col("item_id") % 3 == 0, F.left("text", F.lit(12))), F.lit("")), F.lit("none"))
    tags = F.concat(F.array(F.lit("benchmark")), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")))
    return table(spark, d, "benchmark").select("item_id", asked.alias("question"), tags.alias("tags"))
