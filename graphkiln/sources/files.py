"""Readers and writers of knowledge-graph JSON, Markdown and row files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names under which relationships give their ends, first wins.
SOURCE_NAMES = ("source", "start_id", "start", "startNode", "from")
TARGET_NAMES = ("target", "end_id", "end", "endNode", "to")

NODE = "struct<id:string,labels:array<string>,properties:map<string,variant>>"
EDGE = "struct<id:string,type:string," + ",".join(f"`{n}`:string" for n in (*SOURCE_NAMES, *TARGET_NAMES)) + ",properties:map<string,variant>>"


def as_list(value: Column) -> Column:
    """A variant scalar or list as array<string>; null gives none."""
    many = F.try_variant_get(value, "$", "array<string>")
    alone = F.try_variant_get(value, "$", "string")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(is_list, F.filter(many, lambda x: x.isNotNull())).otherwise(F.filter(F.array(alone), lambda x: x.isNotNull()))


def read_kg(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, nodes, relationships), one row a file; unreadable files have null lists."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"nodes array<{NODE}>, relationships array<{EDGE}>").json(path)
    return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), "nodes", "relationships")


def nodes(files: DataFrame) -> DataFrame:
    """(source_file, pos, id, labels, name, aliases, description, chunk_id, model_extracted)"""
    rows = files.select("source_file", F.posexplode("nodes").alias("pos", "n")).filter("n.id IS NOT NULL AND n.id <> ''")
    p = lambda k: F.try_element_at("n.properties", F.lit(k))
    lists = [as_list(p(k)).alias(k) for k in ("aliases", "description", "chunk_id", "model_extracted")]
    return rows.select("source_file", "pos", "n.id", F.coalesce("n.labels", F.array().cast("array<string>")).alias("labels"), F.array_join(as_list(p("name")), " ").alias("name"), *lists)


def relationships(files: DataFrame) -> DataFrame:
    """(source_file, pos, id, type, source, target), ends by any of their names, without those that lack an end."""
    rows = files.select("source_file", F.posexplode("relationships").alias("pos", "r"))
    end = lambda names: F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names])
    out = rows.select("source_file", "pos", "r.id", F.coalesce(F.nullif("r.type", F.lit("")), F.lit("RELATED_TO")).alias("type"), end(SOURCE_NAMES).alias("source"), end(TARGET_NAMES).alias("target"))
    return out.filter("source IS NOT NULL AND target IS NOT NULL")


def write_kg(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder for each source file with one JSON object; nodes: source_file, id, ...; edges: source_file, ..."""
    side = lambda df, name: df.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "source_file"]))).alias(name))
    side(nodes, "nodes").join(side(edges, "relationships"), "source_file", "full").write.partitionBy("source_file").json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .md files below a folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_rows(spark: SparkSession, path: str, schema: str, json_columns: dict[str, str] | None = None) -> DataFrame:
    """JSON lines (blank lines skipped) or CSV; JSON cells of a CSV are parsed by their schemas."""
    if not path.rstrip("/").endswith("csv"):
        return spark.read.schema(schema).json(path)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, schema=schema)
    return df.withColumns({c: F.from_json(c, s) for c, s in (json_columns or {}).items()})


def write_rows(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON cells."""
    cells = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)
