"""Rows behind the review pages: clusters with their first members, questions with the answers of all modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From which silhouette a clustering is good, and acceptable.
GOOD, ACCEPTABLE = 0.5, 0.3


def grade(silhouette: Column) -> Column:
    return F.when(silhouette > GOOD, "good").when(silhouette > ACCEPTABLE, "acceptable").when(silhouette.isNotNull(), "poor").otherwise("unknown")


def cluster_review(assigned: DataFrame, items: DataFrame, shown: int = 50) -> DataFrame:
    """(cluster_id, size, n_labels, members): each cluster but noise, largest lists cut to ``shown`` members by name and id.

    assigned: cluster_id, id; items: id, name, label. ``shown`` is the page's limit; sizes and label counts are of all members.
    """
    rows = assigned.select("cluster_id", "id").filter("cluster_id <> 'noise'").join(items.select("id", "name", "label"), "id", "left")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.coalesce("name", F.lit("")), "id"))
    first = rows.withColumn("_k", place).filter(F.col("_k") <= shown).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"]).alias("members"))
    return rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.countDistinct("label").alias("n_labels")).join(first, "cluster_id")


def answer_review(rows: DataFrame) -> DataFrame:
    """(id, question, answers): a question with what each mode answered, by mode. rows: id, question, mode, answer, status; of several rows of a mode the first by status and answer counts."""
    one = rows.groupBy("id", "mode").agg(F.min("question").alias("question"), F.min(F.struct("status", "answer")).alias("a"))
    entry = F.struct("mode", "a.status", "a.answer")
    return one.groupBy("id").agg(F.min("question").alias("question"), F.array_sort(F.collect_list(entry)).alias("answers"))
