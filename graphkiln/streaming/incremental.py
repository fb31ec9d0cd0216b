"""Incremental graph updates and progress tables with Structured Streaming."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphkiln.functions.cut import cut
from graphkiln.operators.graph import upsert_nodes


class KeyedTable:
    """A Parquet table in ``parts`` folders by a hash of the key; a version is a list of the folders that count.

    A merge writes only the parts that its rows touch, beside the old ones, and then a marker file with the next number, by a
    rename that fails if it exists; the highest complete marker counts. A crash before that leaves the last version as it is, and a
    batch that is repeated gives the same rows, so updates are idempotent. ``KEPT`` versions are kept for readers.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", version: str = "version", parts: int = 16):
        self.spark, self.path, self.schema, self.key, self.version, self.parts = spark, path.rstrip("/"), schema, key, version, parts

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        found = fs.globStatus(self._at("version-*")) or []
        return sorted(int(f.getPath().getName().split("-")[1]) for f in found)

    def _folders(self, number: int) -> dict[int, str]:
        stream = self._fs().open(self._at(f"version-{number:012d}"))
        try:
            return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict[int, str]]:
        numbers = self.versions()
        return (numbers[-1], self._folders(numbers[-1])) if numbers else (0, {})

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(list(self._current()[1].values()))

    def merge(self, rows: DataFrame) -> None:
        number, folders = self._current()
        part = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int")
        rows = cut(rows.select(*self._read([]).columns).withColumn("_part", part))
        touched = sorted(r["_part"] for r in rows.select("_part").distinct().collect())  # at most as many as parts
        if not touched:
            return
        name = f"data-{number + 1:012d}-{uuid.uuid4().hex}"
        old = self._read([folders[p] for p in touched if p in folders])
        merged = upsert_nodes(old, rows.drop("_part"), self.key, self.version)
        merged.withColumn("_part", part).write.partitionBy("_part").parquet(f"{self.path}/{name}")
        self._mark(number + 1, folders | {p: f"{name}/_part={p}" for p in touched})
        self._forget()

    def _mark(self, number: int, folders: dict[int, str]) -> None:
        fs, draft = self._fs(), self._at(f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if fs.exists(self._at(f"version-{number:012d}")) or not fs.rename(draft, self._at(f"version-{number:012d}")):
            fs.delete(draft, False)
            raise RuntimeError("another writer made this version")

    def _forget(self) -> None:
        fs, numbers = self._fs(), self.versions()
        kept = {f for n in numbers[-self.KEPT :] for f in self._folders(n).values()}
        for n in numbers[: -self.KEPT]:
            for folder in set(self._folders(n).values()) - kept:
                fs.delete(self._at(folder), True)
            fs.delete(self._at(f"version-{n:012d}"), False)


def follow(source: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Merge every batch of a stream into the table: within a batch the latest row of a key counts."""

    def batch(rows: DataFrame, number: int) -> None:
        table.merge(rows)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_facts(events: DataFrame, key: str, fact: str, keep: int = 20) -> DataFrame:
    """Keyed ordered state: for every batch of a key's events the last ``keep`` distinct facts so far."""
    import pandas as pd

    def update(k, batches, state):
        facts = list(state.get[0]) if state.exists else []
        every = pd.concat(list(batches))  # a key's events of one batch come in several Arrow batches, in no order
        for x in every.sort_values("ts", kind="stable")["fact"]:
            facts = [f for f in facts if f != x] + [x]
        facts = facts[-keep:]
        state.update((facts,))
        yield pd.DataFrame({"key": [k[0]], "facts": [facts]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(fact).alias("fact"), "ts")
    return rows.groupBy("key").applyInPandasWithState(update, "key string, facts array<string>", "facts array<string>", "update", "NoTimeout")
