"""Runs of named steps: one at a time, written step by step, resumed at the first step without output, cancelled by tag, told as events.

All state is files of a shared folder, made by atomic creation, so a driver that is lost leaves it readable for the next one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENT = "run string, seq long, at timestamp, type string, status string, step string, progress double, rows long, message string"
#: Statuses that end a run.
ENDED = ("completed", "failed", "cancelled")
#: A step: the outputs of the steps before it by name, to its own.
Step = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


class Busy(RuntimeError):
    """Another run holds the folder."""


class Runs:
    """Runs below ``path``. A run's steps are written to ``data/<name>``; a step counts as done when Spark has marked it complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str) -> bool:
        """Create a file; false if there is one."""
        fs = self._fs()
        try:
            stream = fs.create(self._at(name), False)
        except Exception:  # noqa: BLE001  an existing file is the only failure that leaves one behind
            if fs.exists(self._at(name)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def reserve(self, run: str) -> bool:
        return self._put("active", run)

    def active(self) -> str | None:
        if not self._fs().exists(self._at("active")):
            return None
        stream = self._fs().open(self._at("active"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def release(self, run: str) -> None:
        """Give the folder free, also after a lost driver; another run's hold stays."""
        if self.active() == run:
            self._fs().delete(self._at("active"), False)

    def cancelled(self, run: str) -> bool:
        return self._fs().exists(self._at(f"cancel/{run}"))

    def cancel(self, run: str) -> bool:
        """End the active run: its jobs in this session now, else before its next step."""
        if self.active() != run:
            return False
        self._put(f"cancel/{run}", "")
        self.spark.sparkContext.cancelJobsWithTag(run)
        return True

    def tell(self, run: str, kind: str, status: str, step: str | None = None, progress: float | None = None, rows: int | None = None, message: str | None = None) -> None:
        seq = time.time_ns()
        event = {"run": run, "seq": seq, "at": datetime.now(UTC).isoformat(), "type": kind, "status": status, "step": step, "progress": progress, "rows": rows, "message": message}
        self._put(f"events/{run}-{seq}-{uuid.uuid4().hex[:8]}.json", json.dumps(event) + "\n")

    def events(self, run: str | None = None) -> DataFrame:
        if not self._fs().exists(self._at("events")):
            return self.spark.createDataFrame([], EVENT)
        found = self.spark.read.schema(EVENT).json(f"{self.path}/events")
        return found if run is None else found.filter(F.col("run") == run)

    def states(self) -> DataFrame:
        """(run, status, step, started, updated): the last of each run's own events."""
        own = self.events().filter("type = 'status'")
        last = lambda c: F.max_by(c, "seq").alias(c)
        return own.groupBy("run").agg(last("status"), last("step"), F.min("at").alias("started"), F.max("at").alias("updated"))

    def follow(self, run: str, every: float = 0.5, ping: float = 30.0) -> Iterator[dict | None]:
        """A run's events as they come, None after each ``ping`` seconds of silence, until it ends."""
        after, heard = -1, time.monotonic()
        while True:
            fresh = sorted((r.asDict() for r in self.events(run).filter(F.col("seq") > after).collect()), key=lambda e: e["seq"])
            for event in fresh:
                yield event
                if event["type"] == "status" and event["step"] is None and event["status"] in ENDED:
                    return
            if fresh:
                after, heard = fresh[-1]["seq"], time.monotonic()
            elif time.monotonic() - heard >= ping:
                yield None
                heard = time.monotonic()
            time.sleep(every)

    def _done(self, folder: str) -> bool:
        return self._fs().exists(self._at(f"{folder}/_SUCCESS"))

    def run(self, steps: list[tuple[str, Step]], name: str = "main", resume: bool = True, run: str | None = None) -> dict[str, DataFrame]:
        """The outputs of all steps by name. ``resume`` keeps the leading steps that are complete under ``name``; a step after a new one is made anew."""
        run = run or f"run-{datetime.now(UTC):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"
        if not self.reserve(run):
            raise Busy(self.active() or "")
        context, made, kept = self.spark.sparkContext, {}, resume
        context.addJobTag(run)
        try:
            self.tell(run, "status", "running", progress=0.0)
            for k, (step, make) in enumerate(steps):
                folder = f"data/{name}/{k:02d}_{step}"
                kept = kept and self._done(folder)
                if self.cancelled(run):
                    raise InterruptedError(run)
                if not kept:
                    make(self.spark, dict(made)).write.mode("overwrite").parquet(f"{self.path}/{folder}")
                made[step] = self.spark.read.parquet(f"{self.path}/{folder}")
                self.tell(run, "step", "skipped" if kept else "completed", step, (k + 1) / len(steps), made[step].count())
            self.tell(run, "status", "completed", progress=1.0)
            return made
        except BaseException as error:
            ended = "cancelled" if self.cancelled(run) else "failed"
            if len(made) < len(steps):
                self.tell(run, "step", ended, steps[len(made)][0], len(made) / len(steps), message=str(error)[:600])
            self.tell(run, "status", ended, message=str(error)[:600])
            raise
        finally:
            context.removeJobTag(run)
            self.release(run)


class StreamEvents(StreamingQueryListener):
    """Tells the progress of streaming queries as events of a run."""

    def __init__(self, runs: Runs, run: str):
        self.runs, self.run = runs, run

    def onQueryStarted(self, event) -> None:
        self.runs.tell(self.run, "stream", "running", event.name)

    def onQueryProgress(self, event) -> None:
        self.runs.tell(self.run, "stream", "progress", event.progress.name, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.runs.tell(self.run, "stream", "failed" if event.exception else "completed", message=event.exception)
