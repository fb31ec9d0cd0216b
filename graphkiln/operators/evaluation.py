"""Evaluation of triplets and answers: rates with Wilson intervals, score summaries, retries, samples, packing of evidence."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions.cut import cut
from graphkiln.functions.ship import ship

#: A metric of an answer: (question, answer, contexts, reference) to a number; None, NaN or an exception is no value.
Metric = Callable[[str, str, list[str], str], float | None]
#: Metrics that compare with a reference.
WITH_REFERENCE = ("answer_correctness", "context_precision", "context_recall")

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def wilson(good: Column, total: Column) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null without trials."""
    n, p = total.cast("double"), good.cast("double") / total
    middle = p + Z * Z / (2 * n)
    reach = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    size = 1 + Z * Z / n
    ok = total > 0
    return F.when(ok, F.greatest(F.lit(0.0), (middle - reach) / size)), F.when(ok, F.least(F.lit(1.0), (middle + reach) / size))


def triplet_summary(judged: DataFrame) -> DataFrame:
    """Per predicate and overall (predicate null), in one rollup. judged: predicate, label, confidence, valid."""
    ok = F.col("valid")
    sure = ok & F.col("confidence").between(0, 1)
    count = lambda label: F.count_if(ok & (F.col("label") == label)).alias(label)
    out = judged.rollup("predicate").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid_total"), F.count_if(~ok).alias("invalid"),
        count("supported"), count("contradicted"), count("not_enough_info"), F.avg(F.when(sure, F.col("confidence"))).alias("mean_confidence"),
    )
    low, high = wilson(F.col("supported"), F.col("valid_total"))
    share = F.when(F.col("valid_total") > 0, F.col("supported") / F.col("valid_total"))
    return out.withColumns({"supported_rate": share, "low": low, "high": high})


def macro_rate(judged: DataFrame) -> DataFrame:
    """The mean of the predicates' supported rates, and the overall rate."""
    by = judged.filter("valid").groupBy("predicate").agg(F.count_if(F.col("label") == "supported").alias("s"), F.count("*").alias("n"))
    return by.agg(F.avg(F.col("s") / F.col("n")).alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def number(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def score_summary(rows: DataFrame, by: str, metrics: list[str], status: str = "status") -> DataFrame:
    states = ("ok", "scored", "partial", "error", "skipped")
    return rows.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in states], *[F.avg(number(F.col(m))).alias(f"avg_{m}") for m in metrics])


def classify_scores(metrics: list[str]) -> Column:
    """scored if all metrics are numbers, partial if some, error if none."""
    n = sum((number(F.col(m)).isNotNull().cast("int") for m in metrics), F.lit(0))
    return F.when(n == len(metrics), "scored").when(n > 0, "partial").otherwise("error")


def score_answers(rows: DataFrame, metrics: dict[str, Metric], done: DataFrame | None = None) -> DataFrame:
    """(id, one column a metric, status, error, valid, invalid): every answer scored once; rows of ``done`` (the same columns) stay as they are.

    rows: id (unique), status, error, question, answer, contexts (array), reference; null status is "ok". Failed rows and rows that lack
    what a metric needs are skipped; without a value of any metric the status is "error", of some "partial", else "scored".
    """
    ship(rows.sparkSession)
    if done is not None:
        rows = rows.join(done.select("id"), "id", "left_anti")
    names = list(metrics)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    contexts = F.filter(F.transform(F.coalesce("contexts", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    reason = F.when(F.coalesce("status", F.lit("ok")) != "ok", F.coalesce(F.nullif("error", F.lit("")), F.lit("generation row failed")))
    reason = reason.when(blank("answer"), "missing answer").when(F.size(contexts) == 0, "missing contexts")
    if set(names) & set(WITH_REFERENCE):
        reason = reason.when(blank("reference"), "missing reference")

    def value(metric: Metric, *given) -> float | None:
        try:
            return metric(*given)
        except Exception:  # noqa: BLE001  a failed metric has no value
            return None

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(question: pd.Series, answer: pd.Series, found: pd.Series, reference: pd.Series, skip: pd.Series) -> pd.DataFrame:
        given = [(q or "", a or "", list(c), r or "") for q, a, c, r in zip(question, answer, found, reference, strict=True)]
        return pd.DataFrame({n: pd.array([None if s else value(m, *g) for g, s in zip(given, skip, strict=True)], dtype="Float64") for n, m in metrics.items()})

    rows = rows.select("id", reason.alias("_skip"), run.asNondeterministic()("question", "answer", contexts, "reference", reason.isNotNull()).alias("_m"))
    rows = rows.select("id", "_skip", *[number(F.col(f"_m.{n}")).alias(n) for n in names])
    having = lambda good: F.filter(F.array(*[F.when(F.col(n).isNotNull() if good else F.col(n).isNull(), n) for n in names]), lambda x: x.isNotNull())
    skipped, none = F.col("_skip").isNotNull(), F.array().cast("array<string>")
    state = F.when(skipped, "skipped").otherwise(classify_scores(names))
    why = F.when(skipped, F.col("_skip")).when(F.size(having(True)) == 0, "no valid metric values returned").when(F.size(having(False)) > 0, F.concat(F.lit("invalid metrics: "), F.array_join(having(False), ", ")))
    out = rows.select("id", *names, state.alias("status"), why.alias("error"), F.when(skipped, none).otherwise(having(True)).alias("valid"), F.when(skipped, none).otherwise(having(False)).alias("invalid"))
    return out if done is None else done.select(*out.columns).unionByName(out)


def shared_keyphrases(similar: DataFrame, phrases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b, shared): for similar pairs without a link in ``known``, in either order, the sorted keyphrases of both, if any.

    similar, known: a, b; phrases: id, keyphrases. A pair that is there in both orders counts once, with a < b.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = ordered(similar)
    pairs = pairs if known is None else pairs.join(ordered(known), ["a", "b"], "left_anti")
    pairs = pairs.join(phrases.toDF("a", "_x"), "a").join(phrases.toDF("b", "_y"), "b")
    return pairs.select("a", "b", F.array_sort(F.array_intersect("_x", "_y")).alias("shared")).filter(F.size("shared") > 0)


def stratified_sample(df: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    rank = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= n).drop("_r")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` plus ``rank`` from 1 in the order of columns that together are unique: positions in a range sort's partitions plus the rows before.

    Only one number a partition is gathered.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_k", within).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")


def dedupe_first(df: DataFrame, key: Column, rank: str) -> DataFrame:
    """The row of the lowest rank for each key."""
    order = Window.partitionBy(key).orderBy(rank)
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def pack(df: DataFrame, group: str, rank: str, text: str, max_items: int, max_chars: int) -> DataFrame:
    """In rank order, items while their number and summed length fit; the first is always kept, and the first overflow ends it."""
    order = Window.partitionBy(group).orderBy(rank)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_n": F.row_number().over(order), "_chars": F.sum(F.length(text)).over(upto)})
    over = (F.col("_n") > 1) & ((F.col("_n") > max_items) | (F.col("_chars") > max_chars))
    df = df.withColumn("_over", F.max(over).over(upto))
    return df.filter("NOT _over").withColumnRenamed("_n", "item").withColumnRenamed("_chars", "chars_so_far").drop("_over")


def retry_join(samples: DataFrame, modes: DataFrame, prior: DataFrame) -> DataFrame:
    """Samples x modes with the prior row by (id, mode), else by (question with white space collapsed, mode); ``retry`` if none is good."""
    flat = F.trim(F.regexp_replace("question", r"\s+", " "))
    wanted = samples.join(F.broadcast(modes)).withColumn("_q", flat)
    by_id = prior.filter("id IS NOT NULL").select("id", "mode", F.col("answer").alias("_a1")).dropDuplicates(["id", "mode"])
    by_text = prior.filter("id IS NULL").select(flat.alias("_q"), "mode", F.col("answer").alias("_a2")).dropDuplicates(["_q", "mode"])
    joined = wanted.join(by_id, ["id", "mode"], "left").join(by_text, ["_q", "mode"], "left")
    answer = F.coalesce("_a1", "_a2")
    return joined.select("id", "mode", answer.alias("answer"), failed(answer).alias("retry"))


def failed(answer: Column) -> Column:
    return F.coalesce(F.trim(answer) == "", F.lit(True)) | F.coalesce(F.lower(answer).contains("provider error"), F.lit(False))


def largest_remainder(quotas: DataFrame, target: int) -> DataFrame:
    """(name, quota, seats): ``target`` seats in proportion to quotas by largest remainders, ties by rule order. quotas: name, quota, pos."""
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = quotas.withColumn("_exact", F.col("quota") * target / F.sum("quota").over(every)).withColumn("_base", F.floor("_exact"))
    df = df.withColumn("_rest", target - F.sum("_base").over(every))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 12)), "pos"))
    return df.withColumn("_k", rank).select("name", "quota", (F.col("_base") + (F.col("_k") <= F.col("_rest")).cast("long")).alias("seats"))
