from __future__ import annotations

import random
from collections import Counter

from graphkiln.operators import resolution


def _brute(rows, least):
    found = []
    for block, a, v in rows:
        for other, b, w in rows:
            if None not in (block, a, b, v, w) and block == other and a < b and v + w:
                share = len(set(v) & set(w)) / len(set(v) | set(w))
                found += [(block, a, b, round(share, 6))] * (share >= least)
    return Counter(found)


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolution, "SIDE", 4)
    draw = random.Random(5)
    sets = [sorted({draw.choice("abcdefg") for _ in range(draw.randint(1, 5))} | {f"own{k}" for _ in range(draw.randint(0, 1))}) for k in range(30)]
    rows = [(draw.choice([1, 2]), k, draw.choice(sets)) for k in range(150)]
    # Copies of a set that shares too little with the others of its class, a key given twice, nulls.
    rows += [(3, 500 + k, ["p", "q", "r", f"s{k // 2}", f"t{k // 2}", f"u{k // 2}", f"v{k // 2}"]) for k in range(8)] + [(1, 7, sets[0]), (None, 900, ["a"]), (1, None, ["a"]), (1, 901, None)]
    found = resolution.jaccard_pairs(spark.createDataFrame(rows, "block int, key long, words array<string>"), 0.5).collect()
    assert Counter(map(tuple, found)) == _brute(rows, 0.5)


def test_many_rows_of_a_class(spark):
    """Sets of two classes, told apart by a word of their own: each class's rows pair up, the copies of a set at 1."""
    rows = spark.range(4000).selectExpr("1 AS block", "id AS key", "array('x', 'y', concat('o', id % 3900), IF(id % 2 = 0, 'even', 'odd')) AS words")
    found = {r.jaccard: r["count"] for r in resolution.jaccard_pairs(rows, 0.6).groupBy("jaccard").count().collect()}
    assert found == {0.6: 2 * (2000 * 1999 // 2) - 100, 1.0: 100}
