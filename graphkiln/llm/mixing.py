"""Mixing sources to target weights by capped water-filling.

The targets: every source gets its weight's share of the whole size, no source more than ``max_epochs`` times its own
size; what the caps cut off is shared out again by weight until no source is above its cap. In closed form the level is
found from prefix sums over the sources in order of cap / weight, which are made by partitions of a range sort. A source that needs ``e`` epochs repeats each of its
documents ``floor(e)`` times; for the rest, each document has a seeded hash bin, and the bins below a cutoff are taken
once more. The cutoff is set from the bins' summed sizes so that the words taken come as near the target as whole
documents allow. Only sums by (source, bin) are shuffled, pre-aggregated; documents never move, however large a source.

Defined results: a null source is a source of its own, last in order; null texts have size 0 and are taken like others;
a source of size 0 has target 0; repeated rows share a bin and are taken alike; an empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.llm.common import bounded_broadcast, materialize, running, tidy, words, written

BINS = 4096
SEED = 7


def hash_bin(key: Column, size: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(BINS)).cast("int")


def plan(sized: DataFrame, cycle: list[int], max_epochs: int = 3) -> DataFrame:
    """Per source (_source, _null): source_size, target, _whole (repetitions of every document) and _cutoff (first bin not taken once more).

    ``sized``: _source (null as ''), _null, _bin, _size.
    """
    by_bin = materialize(sized.groupBy("_source", "_null", "_bin").agg(F.sum("_size").alias("_size")), "mix-bins")
    sources = by_bin.groupBy("_source", "_null").agg(F.sum("_size").alias("source_size"))
    sources = running(sources, ["_null", "_source"], {"_rank": F.lit(1).cast("long")}, "mix-ranks")
    weight = F.get(F.array(*[F.lit(int(w)) for w in cycle]), F.pmod(F.col("_rank") - 1, F.lit(len(cycle))).cast("int"))
    sources = sources.select("_source", "_null", "source_size", weight.cast("long").alias("_weight"), (F.col("source_size") * max_epochs).alias("_cap"))
    sources = sources.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight"))
    sources = materialize(running(sources, ["_ratio", "_null", "_source"], {"_caps": F.col("_cap"), "_upto": F.col("_weight")}, "mix-rising"), "mix-sources")
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_weight"), F.lit(0)).alias("weight")).first()
    # What is left for a source and those after it if all before it are capped; the first that this doesn't cap sets the level.
    left, weights = F.lit(whole["size"]) - (F.col("_caps") - F.col("_cap")), F.lit(whole["weight"]) - (F.col("_upto") - F.col("_weight"))
    sources = sources.withColumn("_left", left.cast("long")).withColumn("_weights", weights.cast("long"))
    open_ = sources.filter(F.col("_left").cast("double") / F.col("_weights") <= F.col("_ratio"))
    level = open_.agg(F.min(F.struct("_ratio", "_null", "_source", "_left", "_weights")).alias("x")).first()["x"]
    target = F.col("_cap").cast("double")
    if level:
        target = F.least(target, (F.col("_weight") * F.lit(level["_left"])).cast("double") / F.lit(level["_weights"]))
    sources = sources.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.select("_source", "_null", "source_size", "target", F.floor(epochs).alias("_whole"), (F.col("target") - F.floor(epochs) * F.col("source_size")).alias("_rest"))

    upto = F.sum("_size").over(Window.partitionBy("_source", "_null").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = by_bin.withColumn("_upto", upto).join(sources, ["_source", "_null"])
    gap = F.abs(F.col("_upto") - F.col("_rest"))
    cuts = cuts.groupBy("_source", "_null", "source_size", "target", "_whole", "_rest").agg(F.min(F.struct(gap.alias("gap"), (F.col("_bin") + 1).alias("bin"))).alias("_cut"))
    cutoff = F.when(F.col("_cut.gap") < F.col("_rest"), F.col("_cut.bin")).otherwise(0)
    return cuts.select("_source", "_null", "source_size", "target", "_whole", cutoff.alias("_cutoff"))


def copies(docs: DataFrame, key: str, text: str, source: str, cycle: list[int], max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """(_row: the document's columns; _size, source_size, target, _copies) for every document."""
    size = F.size(words(F.col(f"`{text}`"))).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_source"), F.col(f"`{source}`").isNull().alias("_null"), F.col(f"`{key}`").alias("_key"), size.alias("_size"))
    sized = sized.withColumn("_bin", hash_bin(F.col("_key"), F.col("_size"), seed)).drop("_key")
    mark = written()
    planned = materialize(plan(sized.drop("_row"), cycle, max_epochs), "mix-plan")
    tidy(mark, planned)
    joined = sized.join(bounded_broadcast(planned), ["_source", "_null"])
    return joined.select("_row", "_size", "source_size", "target", (F.col("_whole") + (F.col("_bin") < F.col("_cutoff")).cast("long")).alias("_copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: list[int] = (5, 2, 1), max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns it came with."""
    taken = copies(docs, key, text, source, list(cycle), max_epochs, seed).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
