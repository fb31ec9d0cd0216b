from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphkiln.sources import files
from graphkiln.streaming.incremental import KeyedTable, follow, running_facts


def test_kg_json(spark, tmp_path):
    kg = {"nodes": [{"id": "a", "labels": ["P"], "properties": {"name": "Ann", "aliases": "An", "description": ["x", "y"]}}, {"id": "", "labels": []}], "relationships": [{"id": "r", "type": "", "start": "a", "to": "b"}, {"id": "s", "type": "T", "source": "a"}]}
    (tmp_path / "a.json").write_text(json.dumps(kg))
    (tmp_path / "b.json").write_text("{broken")
    read = files.read_kg(spark, str(tmp_path))
    rows = files.nodes(read).collect()
    assert [(r.source_file, r.id, r.name, r.aliases, r.description, r.chunk_id) for r in rows] == [("a.json", "a", "Ann", ["An"], ["x", "y"], [])]
    assert [(r.type, r.source, r.target) for r in files.relationships(read).collect()] == [("RELATED_TO", "a", "b")]
    files.write_kg(files.nodes(read), files.relationships(read), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_rows_and_markdown(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("# Hi\n\ntext")
    assert [r.text for r in files.read_markdown(spark, str(tmp_path)).collect()] == ["# Hi\n\ntext"]
    df = spark.createDataFrame([(1, ["a", "b"], 'q "x"')], "id int, tags array<string>, t string")
    files.write_rows(df, str(tmp_path / "csv"))
    back = files.read_rows(spark, str(tmp_path / "csv"), "id int, tags string, t string", {"tags": "array<string>"})
    assert back.collect() == df.collect()


def test_incremental_stream(spark, tmp_path):
    source, table = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), "id string, name string, version long")
    spark.createDataFrame([("a", "A1", 1), ("b", "B1", 1), ("a", "A2", 2)], "id string, name string, version long").write.parquet(source)
    stream = spark.readStream.schema("id string, name string, version long").parquet(source)
    follow(stream, table, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b", "B3", 3), ("c", "C1", 1), ("a", "old", 0)], "id string, name string, version long").write.mode("append").parquet(source)
    follow(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.name) for r in table.read().collect()) == [("a", "A2"), ("b", "B3"), ("c", "C1")]


def test_running_facts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("k", "x", 3), ("l", "z", 1)], "k string, fact string, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(source)
    stream = spark.readStream.schema("k string, fact string, ts timestamp").parquet(source)
    query = running_facts(stream, "k", "fact", 2).writeStream.format("memory").queryName("facts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.key: r.facts for r in spark.table("facts").collect()} == {"k": ["y", "x"], "l": ["z"]}
