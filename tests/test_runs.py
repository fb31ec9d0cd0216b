from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from graphkiln.operators import evaluation, reports
from graphkiln.operators.runs import Busy, Runs, StreamEvents
from graphkiln.sources import web


def test_resume(spark, tmp_path):
    runs, fail = Runs(spark, str(tmp_path)), [True]

    def second(spark, made):
        if fail:
            raise ValueError("lost")
        return made["a"].filter("id > 2")

    steps = [("a", lambda spark, made: spark.range(5)), ("b", second), ("c", lambda spark, made: made["b"])]
    with pytest.raises(ValueError):
        runs.run(steps, run="one")
    assert runs.active() is None
    fail.clear()
    assert runs.run(steps, run="two")["c"].count() == 2
    told = {r: [(e.step, e.status, e.rows) for e in runs.events(r).orderBy("seq").collect()] for r in ("one", "two")}
    assert told["one"] == [(None, "running", None), ("a", "completed", 5), ("b", "failed", None), (None, "failed", None)]
    assert told["two"] == [(None, "running", None), ("a", "skipped", 5), ("b", "completed", 2), ("c", "completed", 2), (None, "completed", None)]
    assert {r.run: r.status for r in runs.states().collect()} == {"one": "failed", "two": "completed"}
    assert [e["status"] for e in runs.follow("two")][-1] == "completed"


def test_one_at_a_time_and_cancel(spark, tmp_path):
    runs, ended = Runs(spark, str(tmp_path)), []

    def slow(spark, made):
        @F.udf("long")
        def wait(x):
            time.sleep(60)
            return x

        return spark.range(8).select(wait("id").alias("id"))

    def work():
        try:
            runs.run([("slow", slow)], run="r")
        except Exception as error:  # noqa: BLE001
            ended.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(300):
        if runs.active() == "r":
            break
        time.sleep(0.1)
    time.sleep(3)
    with pytest.raises(Busy):
        runs.run([], run="other")
    assert not runs.cancel("other") and runs.cancel("r")
    thread.join(30)
    assert ended and runs.active() is None and [r.status for r in runs.states().collect()] == ["cancelled"]


def test_stream_events(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"))
    listener = StreamEvents(runs, "s")
    spark.range(4).write.parquet(str(tmp_path / "in"))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("told").format("memory")
        stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            found = [(e.status, e.rows) for e in runs.events("s").orderBy("seq").collect()]
            if found and found[-1][0] == "completed":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert found[0] == ("running", None) and ("progress", 4) in found and found[-1][0] == "completed"


def test_scores(spark):
    def broken(q, a, c, r):
        if a == "x":
            raise ValueError(a)
        return float("nan") if a == "n" else 0.5

    rows = [(1, "ok", None, "q", "a", ["c"], "r"), (2, None, None, "q", "x", ["c"], None), (3, "error", "late", "q", "a", ["c"], "r"), (4, "ok", None, "q", "", ["c"], "r"), (5, "ok", None, "q", "a", [" ", None], "r"), (6, "ok", None, None, "n", ["c"], ""), (7, "error", None, "q", None, None, None)]
    df = spark.createDataFrame(rows, "id long, status string, error string, question string, answer string, contexts array<string>, reference string")
    metrics = {"faithfulness": broken, "answer_relevancy": lambda q, a, c, r: float(len(c)) if q else None}
    out = evaluation.score_answers(df, metrics)
    found = {r.id: (r.faithfulness, r.answer_relevancy, r.status, r.error) for r in out.collect()}
    assert found[1] == (0.5, 1.0, "scored", None) and found[2] == (None, 1.0, "partial", "invalid metrics: faithfulness")
    assert found[3][2:] == ("skipped", "late") and found[4][2:] == ("skipped", "missing answer") and found[5][2:] == ("skipped", "missing contexts")
    assert found[6] == (None, None, "error", "no valid metric values returned") and found[7][2:] == ("skipped", "generation row failed")
    again = evaluation.score_answers(df, {"faithfulness": lambda *_: 9.0, "answer_relevancy": lambda *_: 9.0}, out.filter("id <> 2"))
    assert {r.id: r.faithfulness for r in again.collect()} == {1: 0.5, 2: 9.0} | dict.fromkeys(range(3, 8))
    assert evaluation.score_answers(df, {"context_recall": lambda *_: 1.0}).filter("error = 'missing reference'").count() == 2


def test_fetched(spark):
    rows = [("a", 404, None), ("a", 200, "x"), ("b", None, None), ("c", 200, None), ("d", 500, "y"), ("e", 200, "z"), (None, 200, "n")]
    df = spark.createDataFrame(rows, "url string, status int, html string")
    out = web.fetched(df, spark.createDataFrame([("e",)], "url string"))
    assert {r.url: (r.html, r.error) for r in out.collect()} == {"a": ("x", None), "b": (None, "no answer"), "c": (None, "empty"), "d": (None, "HTTP 500")}


def test_posts(spark):
    post = lambda k, *terms: {"id": k, "title": {"rendered": f"t{k}"}, "content": {"rendered": "h"}, "_embedded": {"wp:term": [[{"id": t, "name": f"n{t}"} for t in group] for group in terms]}}
    body = lambda *ps: json.dumps(list(ps))
    rows = [(1, 200, None, body(post(1, [1], [5, 6]), {"id": 2})), (2, 429, None, None), (2, 200, None, body(post(3, [1]))), (3, 200, None, "[]"), (4, 200, None, body(post(4)))]
    schema = "page int, status int, total_pages int, body string"
    found = web.posts(spark.createDataFrame(rows, schema))
    assert sorted((r.page, r.id, r.title) for r in found.collect()) == [(1, 1, "t1"), (1, 2, None), (2, 3, "t3")]
    assert sorted((r.kind, r.id, r.name, r.n) for r in web.term_counts(found).collect()) == [("categories", 1, "n1", 2), ("tags", 5, "n5", 1), ("tags", 6, "n6", 1)]
    ends = lambda rows, **k: sorted(r.id for r in web.posts(spark.createDataFrame(rows, schema), **k).collect())
    assert ends([(1, 200, 1, body(post(1))), (2, 200, 1, body(post(2)))]) == [1]
    assert ends([(1, 200, None, body(post(1))), (2, 500, None, "x"), (3, 200, None, body(post(3)))]) == [1]
    assert ends([(k, 200, None, body(post(k))) for k in (1, 2, 3)], max_pages=2) == [1, 2]
    assert ends([(1, 200, None, "{broken")]) == []


def test_reports(spark):
    assigned = spark.createDataFrame([("c0", k) for k in range(5)] + [("noise", 9)], "cluster_id string, id long")
    items = spark.createDataFrame([(0, "b", "x"), (1, "a", "y"), (2, None, "x")], "id long, name string, label string")
    assert [tuple(r) for r in reports.cluster_review(assigned, items, 3).collect()] == [("c0", 5, 2, [2, 3, 4])]
    scores = spark.createDataFrame([(0.6,), (0.4,), (0.3,), (None,)], "s double")
    assert [r.g for r in scores.select(reports.grade(F.col("s")).alias("g")).collect()] == ["good", "acceptable", "poor", "unknown"]
    rows = [(1, "q", "direct", "b", "ok"), (1, "q", "direct", "a", "ok"), (1, "q", "hybrid", None, "error")]
    out = reports.answer_review(spark.createDataFrame(rows, "id long, question string, mode string, answer string, status string")).collect()
    assert [(r.id, r.question, [tuple(a) for a in r.answers]) for r in out] == [(1, "q", [("direct", "ok", "a"), ("hybrid", "error", None)])]
