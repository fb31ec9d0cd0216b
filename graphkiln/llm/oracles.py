"""DuckDB SQL that computes what the queries return, written from the definitions."""

from __future__ import annotations

from graphkiln.llm import mixing, quality
from graphkiln.llm.sharding import fill

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _distance(counts: str, reference: list[float]) -> str:
    ref = f"[{', '.join(f'{q!r}::DOUBLE' for q in map(float, reference))}]"
    share = f"list_transform({counts}, lambda c: c::DOUBLE / list_sum({counts})::DOUBLE)"
    part = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2.0::DOUBLE * {a} / ({a} + {b})) ELSE 0.0::DOUBLE END)"
    parts = f"list_transform(list_zip({share}, {ref}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})"
    return f"(CASE WHEN list_sum({counts}) > 0 THEN sqrt(greatest(list_reduce({parts}, lambda a, x: a + x) / 2.0::DOUBLE, 0.0::DOUBLE)) ELSE 1.0::DOUBLE END)"


def quality_rules() -> str:
    count = lambda w: f"len(list_filter(ws, lambda x: x = '{w}'))"
    by_class = {lang: _distance("classes", ref) for lang, ref in quality.CLASS_REFERENCES.items()}
    seen = {lang: [count(w) for w in ref] for lang, ref in quality.WORD_REFERENCES.items()}
    lists = ", ".join(f"[{', '.join([*x, f'n - ({' + '.join(x)})'])}] AS words_{lang}" for lang, x in seen.items())
    by_word = {lang: _distance(f"words_{lang}", [*ref.values(), 1 - sum(ref.values())]) for lang, ref in quality.WORD_REFERENCES.items()}
    runs = lambda regex: f"len(regexp_extract_all(chars, '{regex}'))"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
grams AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
keyed AS (SELECT rid, i, list_slice(ws, i, i + 2) AS g FROM grams),
found AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM keyed),
spots AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM found WHERE c > 1),
rep AS (SELECT rid, count(*) AS r FROM spots GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
a AS (
  SELECT d.doc_id, d.rid, ws, len(ws) AS n, array_to_string(ws, '') AS chars, coalesce(r, 0) AS repeated, len(ls) - len(list_distinct(ls)) AS dup
  FROM d JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
b AS (
  SELECT *, length(chars) AS size, {runs('[a-z]')} AS lower_, {runs('[A-Z]')} AS upper_, {runs('[0-9]')} AS digit, len(regexp_extract_all(regexp_replace(chars, '[A-Za-z]+', '', 'g'), '\p{{L}}')) AS other,
    len(regexp_extract_all(chars, '[.,;:!?''"()\-]')) AS punct, {runs('[#*$%&|<>]')} AS symbols FROM a),
c AS (SELECT *, [lower_, upper_, digit, other, punct, size - lower_ - upper_ - digit - other - punct] AS classes, {lists} FROM b),
e AS (SELECT *, {', '.join(f'{x} AS c_{lang}' for lang, x in by_class.items())}, {', '.join(f'{x} AS w_{lang}' for lang, x in by_word.items())} FROM c),
f AS (SELECT *, least({', '.join(f'c_{x}' for x in by_class)}) AS class_distance, least({', '.join(f'c_{x} + w_{x}' for x in by_class)}) AS sum_distance, n < {quality.MIN_WORDS} OR 100 * repeated > {quality.MAX_REPEATED_PERCENT} * n AS base_failed FROM e)
SELECT doc_id, n::BIGINT AS n_words, size::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, repeated::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR (NOT other > {quality.MAX_FOREIGN_SHARE} * size AND ((size >= {quality.MIN_CHARS} AND class_distance >= {quality.MAX_CLASS_DISTANCE}) OR (n >= {quality.MIN_WORDS_BOTH} AND sum_distance >= {quality.MAX_SUM_DISTANCE})))) AS kept
FROM f"""


def sharding(shards: list[str]) -> str:
    owner = fill(shards)
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
SELECT doc_id, slot::INTEGER AS slot, [{names}][({owner})[slot + 1] + 1] AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {len(owner)} AS slot FROM documents)"""


def source_mixing(cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {list(cycle)}[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(cycle)})::INT + 1] AS w FROM d GROUP BY source),
fill(k, level, capped) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(w) FROM s), 0
  UNION ALL
  SELECT k + 1, (SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum({max_epochs} * source_size) FILTER (WHERE {max_epochs} * source_size < w * level), 0))::DOUBLE / sum(w) FILTER (WHERE {max_epochs} * source_size >= w * level) FROM s), (SELECT count(*) FROM s WHERE {max_epochs} * source_size < w * level)
  FROM fill WHERE k < (SELECT count(*) FROM s)),
last AS (SELECT level FROM fill ORDER BY k DESC LIMIT 1),
left_ AS (SELECT (sum(source_size) - (SELECT coalesce(sum({max_epochs} * source_size), 0) FROM s, last WHERE {max_epochs} * source_size < w * level))::BIGINT AS rest, (SELECT sum(w) FROM s, last WHERE {max_epochs} * source_size >= w * level)::BIGINT AS weights FROM s),
t AS (SELECT s.*, least(({max_epochs} * source_size)::DOUBLE, (w * rest)::DOUBLE / weights) AS target FROM s, left_),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
b AS (SELECT d.*, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 8))::BIGINT % {mixing.BINS} AS bin FROM d),
u AS (SELECT source, bin, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS upto FROM b GROUP BY source, bin),
g AS (SELECT u.source, bin, abs(upto - (target - whole * source_size)) AS gap, target - whole * source_size AS rest FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source),
c AS (SELECT source, CASE WHEN min(gap) < min(rest) THEN arg_min(bin, (gap, bin)) + 1 ELSE 0 END AS cutoff FROM g GROUP BY source)
SELECT b.doc_id, size, source_size, target, ((whole + CASE WHEN bin < cutoff THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source JOIN c ON b.source IS NOT DISTINCT FROM c.source"""


def jaccard_groups(size: int = 4, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {size} - 1), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size} + 1, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.v FROM r JOIN e ON r.node = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(node) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id"""


def embedding_groups(cosine: float = 0.95) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, e FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.rid AS rid, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.rid <> b.rid WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}),
r(id, node) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.node = l.a),
c AS (SELECT id, min(node) AS component_id FROM r GROUP BY id), n AS (SELECT rid, count(*) AS n FROM l GROUP BY rid)
SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(x.vec_id = c.component_id, true) AS kept
FROM embeddings x JOIN v ON v.vec_id IS NOT DISTINCT FROM x.vec_id AND v.e IS NOT DISTINCT FROM x.embedding::DOUBLE[] LEFT JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.rid = v.rid"""
