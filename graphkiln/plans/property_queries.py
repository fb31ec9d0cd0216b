"""Queries of merged properties: an event's kind, its tags (a list every third time) and its text are properties of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.operators import properties
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


ROWS = """e AS (SELECT user_id AS id, event_id AS pos, 'kind' AS key, false AS many, [event_type] AS v FROM events
UNION ALL SELECT user_id, event_id, 'tags', event_id % 3 = 0, CASE WHEN event_id % 3 = 0 THEN [event_type, 'all'] ELSE [event_type] END FROM events
UNION ALL SELECT user_id, event_id, 'props', false, [props] FROM events WHERE props <> ''),
i AS (SELECT id, key, many, pos, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e)"""
LISTED = "l AS (SELECT id, key, list(x ORDER BY pos, k) AS merged FROM (SELECT id, key, x, min(struct_pack(pos, k)).pos AS pos, min(struct_pack(pos, k)).k AS k FROM t GROUP BY id, key, x) GROUP BY id, key)"


def _rows(spark, d) -> DataFrame:
    tags = F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.lit("all")).cast("variant")).otherwise(F.col("event_type").cast("variant"))
    cells = F.create_map(F.lit("kind"), F.col("event_type").cast("variant"), F.lit("tags"), tags, F.lit("props"), F.col("props").cast("variant"))
    return properties.values(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), cells.alias("properties")))


def _shown(merged: DataFrame) -> DataFrame:
    return merged.select("id", "key", "many", F.col("values").alias("merged"))


@query(f"""WITH {ROWS}, f AS (SELECT id, key, arg_min(many, pos) OR key = 'kind' AS many, arg_min(v, pos) AS v FROM e GROUP BY id, key), t AS (SELECT * FROM i WHERE many OR key = 'kind'), {LISTED}
SELECT f.id, f.key, f.many, CASE WHEN f.many THEN l.merged ELSE f.v END AS merged FROM f LEFT JOIN l USING (id, key)""")
def merge_entity_props(spark, d) -> DataFrame:
    """Blanks are filled, lists and the united key become lists of all, of conflicting scalars the first stays."""
    return _shown(properties.merge(_rows(spark, d), properties.FIRST, ("kind",)))


SCALARS = "b AS (SELECT e.id, e.key, arg_max(v[1], struct_pack(n := length(v[1]), p := -pos)) AS x FROM e JOIN s USING (id, key) WHERE NOT e.many AND (s.since IS NULL OR e.pos < s.since) GROUP BY e.id, e.key)"
CHOSEN = "SELECT s.id, s.key, s.since IS NOT NULL AS many, CASE WHEN s.since IS NOT NULL THEN l.merged ELSE [b.x] END AS merged FROM s LEFT JOIN b USING (id, key) LEFT JOIN l USING (id, key)"


@query(f"""WITH {ROWS}, s AS (SELECT id, key, min(pos) FILTER (many) AS since FROM e GROUP BY id, key), {SCALARS},
t AS (SELECT i.id, i.key, pos, k, x FROM i JOIN s USING (id, key) WHERE pos >= since UNION ALL SELECT b.id, b.key, -1, 0, b.x FROM b JOIN s USING (id, key) WHERE since IS NOT NULL), {LISTED} {CHOSEN}""")
def merge_rule_based_incr(spark, d) -> DataFrame:
    """The longest scalar stays; one that meets a list becomes part of it."""
    return _shown(properties.merge(_rows(spark, d), properties.PROMOTE))


@query(f"""WITH {ROWS}, w AS (SELECT *, coalesce(max(CASE WHEN NOT many THEN length(v[1]) END) OVER (PARTITION BY id, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM e),
s AS (SELECT id, key, min(pos) FILTER (many AND list_sum(list_transform(v, lambda x: length(x) + 4)) > seen) AS since FROM w GROUP BY id, key), {SCALARS},
t AS (SELECT i.id, i.key, pos, k, x FROM i JOIN s USING (id, key) WHERE pos >= since), {LISTED} {CHOSEN}""")
def merge_properties(spark, d) -> DataFrame:
    """The longest scalar stays; a list that is longer as printed takes its place and all later values."""
    return _shown(properties.merge(_rows(spark, d), properties.LONGEST))
