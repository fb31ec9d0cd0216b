from __future__ import annotations

import random

import pytest

from graphkiln.functions import markdown
from graphkiln.operators import resolution, steps, vectors
from graphkiln.plans.text_queries import crawled
from graphkiln.streaming.incremental import KeyedTable


def brute_common(x, y):
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a == b else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_name_similarity(spark):
    choose = random.Random(1)
    rows = [("".join(choose.choices("abcé ", k=choose.randrange(12))), "".join(choose.choices("abcé ", k=choose.randrange(12)))) for _ in range(300)]
    out = spark.createDataFrame(rows, "x string, y string").select("x", "y", resolution.name_similarity("x", "y").alias("s")).collect()
    for r in out:
        assert r.s == (round(200 * brute_common(r.x, r.y) / (len(r.x) + len(r.y))) / 100 if r.x and r.y else 0.0)


def test_splits(spark):
    rows = [(1, 1, "Nguyen Van An", []), (1, 2, "nguyen van anh", []), (1, 3, "Tran Binh", ["tb", "x"]), (1, 4, "B. T.", ["TB "]), (1, 5, None, None), (2, 6, "Khoa Toan", []), (2, 7, "Khoa Toan", [])]
    df = spark.createDataFrame(rows, "cluster long, id long, name string, aliases array<string>")
    assert {r.id: r.part for r in steps.split_persons(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}
    assert {r.id: r.part for r in steps.split_units(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}


def test_main_content():
    assert steps.main_content("<body><main>m</main><article>a<article>b</article></article></body>") == "<article>a<article>b</article>"
    assert steps.main_content("<body><div class='x entry-content'>\n<div>e</div></div>") == "<div class='x entry-content'>\n<div>e</div>"
    assert steps.main_content("<body>open") == "<body>open" and steps.main_content(None) is None


def test_fixed_values(spark):
    urls = ["http://a/wp-admin/x", "http://a/rss/", "http://a/xmlrpc.php", "http://a/b.jpeg", "http://a/b.gif", "http://a/b.zip", "http://a/login", "http://a/search?x#y", "http://a/feeds"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.u for r in df.filter(crawled(df["u"])).collect()] == urls[6:]
    for short in ("QĐ.", "ĐH.", "VD.", "STT.", "v.v."):
        assert markdown.sentences(f"Theo {short} Một câu dài. Hai câu.") == [f"Theo {short} Một câu dài.", "Hai câu."]


@pytest.mark.parametrize("tile", [7, 2048])
def test_nearest_and_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    choose = random.Random(tile)
    rows = [(k, k % 2, [choose.gauss(0, 1) for _ in range(4)]) for k in range(40)] + [(40, 0, [0.0] * 4), (41, 1, None)]
    rows += [(50, 0, rows[0][2])]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cos = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    known = [r for r in rows if r[2] and any(r[2])]
    want = {(a[0], b[0]) for a in known for b in known if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.5}
    assert {(r.a, r.b) for r in vectors.threshold_pairs(df, "id", "v", "g", 0.5).collect()} == want
    best = {(a[0], b[0], k + 1) for a in known for k, b in enumerate(sorted((b for b in known if b[0] != a[0]), key=lambda b: (-round(cos(a[2], b[2]), 12), b[0]))[:3])}
    assert {(r.query, r.id, r["rank"]) for r in vectors.nearest(df, df, "id", "v", 3, skip_self=True).collect()} == best


def test_keyed_table_survives_a_crash(spark, tmp_path, monkeypatch):
    made = KeyedTable(spark, str(tmp_path / "t"), "id string, name string, version long", parts=4)
    frame = lambda rows: spark.createDataFrame(rows, "id string, name string, version long")
    made.merge(frame([("a", "x", 1), ("b", "y", 1)]))
    monkeypatch.setattr(KeyedTable, "_mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        made.merge(frame([("a", "z", 2)]))
    monkeypatch.undo()
    assert sorted((r.id, r.name) for r in made.read().collect()) == [("a", "x"), ("b", "y")]
    for k in range(2, 7):
        made.merge(frame([("a", f"z{k}", k)]))
    assert sorted((r.id, r.name) for r in made.read().collect()) == [("a", "z6"), ("b", "y")] and len(made.versions()) == KeyedTable.KEPT
