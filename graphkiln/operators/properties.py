"""Merging the properties of records that turned out to be one: blanks filled, lists united in order, scalars chosen by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.sources.files import as_list

#: What happens where scalars disagree: the first stays; the longest stays and a list takes it in; the longest stays and gives way to a longer list.
FIRST, PROMOTE, LONGEST = "first", "promote", "longest"


def values(records: DataFrame) -> DataFrame:
    """(id, pos, key, many, values): one row a property that isn't blank (null, "", []). records: id, pos, properties (map of variants)."""
    rows = records.select("id", "pos", F.explode("properties").alias("key", "_v"))
    many = F.coalesce(F.schema_of_variant("_v").startswith("ARRAY"), F.lit(False))
    listed = F.filter(as_list(F.col("_v")), lambda x: x.isNotNull())
    return rows.select("id", "pos", "key", many.alias("many"), listed.alias("values")).filter(F.size("values") > 0).filter(F.col("many") | (F.get("values", F.lit(0)) != ""))


def merge(rows: DataFrame, rule: str = FIRST, united: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, many, values): each property of each id once, from rows of ``values`` in the order of pos (unique within an id).

    FIRST: a scalar that comes first stays, a list that comes first takes the items of later lists; keys in ``united`` become
    lists of all values. PROMOTE: the longest scalar (of equal ones the first) stays, unless there is a list: then the longest
    scalar before it comes first and all later values follow. LONGEST: the longest scalar stays, unless a list longer than it as
    printed comes, which takes its place and all later values. A list holds a value once, at its first place.

    The values of a property are aggregated, not folded: only a merged list is ever in one row.
    """
    keys = ["id", "key"]
    size = F.length(F.get("values", F.lit(0)))
    if rule == FIRST:
        one = F.col("key").isin(*united) if united else F.lit(False)
        heads = rows.groupBy(keys).agg(F.min("pos").alias("_at"), F.min_by(F.struct("many", F.get("values", F.lit(0)).alias("text")), "pos").alias("_f"))
        heads = heads.select(*keys, "_at", F.col("_f.text").alias("_text"), (F.col("_f.many") | one).alias("_many"))
        taken = F.col("many") | one
    else:
        before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        longest = F.coalesce(F.max(F.when(~F.col("many"), size)).over(before), F.lit(0))
        # A list as printed: brackets, two quotes an item, comma and blank between items.
        printed = F.aggregate("values", F.lit(0), lambda s, x: s + F.length(x) + 4)
        starts = F.col("many") if rule == PROMOTE else F.col("many") & (printed > longest)
        heads = rows.withColumn("_starts", starts).groupBy(keys).agg(F.min(F.when(F.col("_starts"), F.col("pos"))).alias("_at"))
        scalars = rows.filter("NOT many").join(heads, keys).filter("_at IS NULL OR pos < _at")
        best = scalars.groupBy(keys).agg(F.max_by(F.get("values", F.lit(0)), F.struct(size, -F.col("pos"))).alias("_text"))
        heads = heads.join(best, keys, "left").withColumn("_many", F.col("_at").isNotNull())
        taken = F.col("pos") >= F.col("_at")
    lists = rows.join(heads.filter("_many").select(*keys, "_at"), keys).filter(taken)
    items = lists.select(*keys, "pos", F.posexplode("values").alias("_i", "_x"))
    if rule == PROMOTE:
        items = items.unionByName(heads.filter("_many AND _text IS NOT NULL").select(*keys, (F.col("_at") - 1).alias("pos"), F.lit(0).alias("_i"), F.col("_text").alias("_x")))
    once = items.groupBy(*keys, "_x").agg(F.min(F.struct("pos", "_i")).alias("_p"))
    made = once.groupBy(keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias("_list"))
    out = heads.join(made, keys, "left")
    return out.select(*keys, F.col("_many").alias("many"), F.when(F.col("_many"), F.col("_list")).otherwise(F.array("_text")).alias("values"))
