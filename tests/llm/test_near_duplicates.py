from __future__ import annotations

import random
import re

import numpy as np
import pytest
from oracle_support import compare
from pyspark.sql import functions as F

from graphkiln.llm import common, forest, jaccard, oracles
from graphkiln.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_jaccard(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i in sets}
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(parent, i)) for i, many in sets.items() for s in many)


def noisy(choose, words, n):
    words = list(words)
    for _ in range(n):
        words[choose.randrange(len(words))] = f"z{choose.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_groups(spark, size, percent):
    choose = random.Random(size)
    vocabulary = [f"w{k}" for k in range(400)]
    base = choose.choices(vocabulary, k=120)
    passage = choose.choices(vocabulary, k=60)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a B"), (5, "a b c"), (6, "a b c d"), (7, "A  b\tc d")]
    rows += [(100 + k, noisy(choose, base, k % 5)) for k in range(150)]
    rows += [(300 + k, " ".join(base)) for k in range(40)]
    rows += [(400 + k, " ".join(choose.choices(vocabulary, k=60) + passage)) for k in range(80)]
    rows += [(500 + k, noisy(choose, choose.choices(vocabulary, k=choose.randint(5, 40)), 0)) for k in range(60)]
    rows += [(600 + k, rows[60 + k][1]) for k in range(40)] + [(7, "A  b\tc d"), (560, "another text of the same id here")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n int, set string").repartition(7)
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(df, size=size, percent=percent).collect())
    assert out == brute_jaccard(rows, size, percent)


def test_jaccard_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    choose = random.Random(3)
    base = [f"w{k}" for k in range(70)]
    rows = [(k, noisy(choose, base, 1 + k % 4)) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(df, size=4, percent=85).collect())
    assert out == brute_jaccard(rows, 4, 85)


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(5, text, "a"), (3, text + " x", "b"), (9, "other words", "c"), (9, "other words", "c"), (4, None, "d"), (None, "q", "e")], "doc_id long, text string, _gone string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "9", "None"]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (9, None), (11, c), (12, ""), (12, c), (None, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = [r for r in rows if r[0] is not None]
    out = jaccard.groups(df, size=4, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == brute_jaccard(known, 4, 85)
    assert [r.component_id for r in out if r.doc_id is None] == [None, None]
    kept = jaccard.keep_one(df.withColumn("_number", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_number"]
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("3", a), ("7", b), ("11", c), ("9", ""), ("12", ""), ("None", c), ("None", a)])


@pytest.mark.parametrize("hot", [2, 10_000])
def test_hot_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    texts = [" ".join(f"{x}{k}" for k in range(30)) for x in "abcd"]
    rows = [(k, texts[0]) for k in range(50, 90)] + [(k, texts[1]) for k in range(10, 13)] + [(100, texts[2]), (101, texts[0] + " more"), (102, None)]
    out = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_jaccard(rows, 4, 85)


def test_running_and_following(spark):
    choose = random.Random(1)
    rows = [(k % 3 and 1, choose.randrange(10**6) * 1000 + k, choose.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    sums = {}
    for g, k, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        sums[g, k] = sums[g]
    out = common.running(df, ["g", "k"], {"s": F.col("v")}, "t", ["g"]).collect()
    assert len(out) == 500 and all(r.s == sums[r.g, r.k] for r in out)
    whole, total = {}, 0
    for g, k, v in sorted(rows):
        total += v
        whole[g, k] = total
    assert {(r.g, r.k): r.s for r in common.running(df, ["g", "k"], {"s": F.col("v")}, "t").collect()} == whole
    by = {}
    for g, k, _ in sorted(rows):
        by.setdefault(g, []).append(k)
    after = {(g, a): b for g, ks in by.items() for a, b in zip(ks, [*ks[1:], None], strict=True)}
    before = {(g, b): a for g, ks in by.items() for a, b in zip([None, *ks[:-1]], ks, strict=True)}
    assert {(r.g, r.k): r.n for r in common.following(df, ["g"], ["k"], "k", "n", "t").collect()} == after
    assert {(r.g, r.k): r.n for r in common.following(df, ["g"], ["k"], "k", "n", "t", back=True).collect()} == before
    assert common.running(df.limit(0), ["k"], {"s": F.col("v")}, "t").count() == 0


def test_components(spark):
    choose = random.Random(4)
    edges = [(choose.randrange(300), choose.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges if None not in e for x in e}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    rows = {r.id: r.component for r in found.collect()}
    assert len(rows) == found.count()
    assert all(rows.get(x, x) == find(parent, x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(n_centres, copies, noise, seed=5, size=24):
    random_ = np.random.default_rng(seed)
    centres = random_.standard_normal((n_centres, size))
    near = centres[:20].repeat(copies, 0) + noise * random_.standard_normal((20 * copies, size))
    return np.concatenate([centres, near, centres[:5], 3 * centres[5:10]])


def brute_vectors(rows):
    """Sorted (id, n_links, component, kept) as the operator defines them, comparing all pairs."""
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    distinct = sorted({(i, tuple(v)) for i, v in rows if i is not None and ok(v)})
    parent = {i: i for i, _ in rows if i is not None}
    links = dict.fromkeys(distinct, 0)
    unit = [np.array(v, "float64") / np.linalg.norm(np.array(v, "float64")) for _, v in distinct]
    for a in range(len(distinct)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[distinct[a]] += 1
                links[distinct[b]] += 1
                x, y = find(parent, distinct[a][0]), find(parent, distinct[b][0])
                parent[max(x, y)] = min(x, y)
    out = [(i, links.get((i, tuple(v)), 0) if ok(v) else 0, find(parent, i)) for i, v in rows if i is not None]
    return sorted((*r, r[0] == r[2]) for r in out) + [(None, 0, None, True) for i, _ in rows if i is None]


def found_vectors(df):
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()]
    return sorted(r for r in out if r[0] is not None) + [r for r in out if r[0] is None]


def test_forest(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 60)
    monkeypatch.setattr(forest, "BLOCK", 40)
    x = planted(200, 12, 0.12).astype("float32")
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, []), (1004, [1.0, None]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (0, rows[0][1]), (None, rows[0][1])]
    rows += [(1007, rows[60][1]), (1007, rows[70][1]), (1007, None), (1, None), (1008, rows[61][1]), (1008, rows[61][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    out, want = found_vectors(df), brute_vectors(rows)
    assert [r[0] for r in out] == [r[0] for r in want] and all(a[1] <= b[1] for a, b in zip(out, want, strict=True))
    assert sum(r[1] for r in out) >= 0.99 * sum(r[1] for r in want)
    assert np.mean([a == b for a, b in zip(out, want, strict=True)]) > 0.97
    assert [r for r in out if (r[0] or 0) >= 1000] == [r for r in want if (r[0] or 0) >= 1000]
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_splits_heavy_leaves(spark, monkeypatch):
    """Far more rows than the sample: recall holds, and no leaf stays heavy but the dense group."""
    for name, value in (("SAMPLE", 64), ("LEAF", 60), ("BLOCK", 50), ("HEAVY", 120)):
        monkeypatch.setattr(forest, name, value)
    rounds = []
    project = forest._project
    monkeypatch.setattr(forest, "_project", lambda rows: rounds.append(1) or project(rows))
    random_ = np.random.default_rng(8)
    x = np.concatenate([planted(1500, 12, 0.12), random_.standard_normal(24) + 0.05 * random_.standard_normal((200, 24))])
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    out = found_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = brute_vectors(rows)
    assert 2 <= len(rounds) <= 12
    assert sum(r[1] for r in out) >= 0.95 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(out, want, strict=True))
    assert np.mean([a[2] == b[2] for a, b in zip(out, want, strict=True)]) > 0.99


def test_forest_same_as_sql_on_planted_links(spark, tmp_path):
    x = planted(150, 8, 0.1, seed=9, size=16).astype("float32")
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(0, rows[0][1]), (700, rows[3][1]), (700, rows[4][1]), (701, None), (702, [0.0] * 16), (1, rows[0][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    compare(spark, lambda s, d: forest.near_duplicates(s.read.parquet(f"{d}/embeddings.parquet")), oracles.embedding_groups(), str(tmp_path))
