from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphkiln.operators import properties


def united(have, more):
    out = list(have) if isinstance(have, list) else [have]
    return out + [x for k, x in enumerate(more) if x not in out and x not in more[:k]]


def folded(found, key, rule):
    """One property after the other, as the rules say."""
    kept = None
    for value in found:
        if value in (None, "", []):
            continue
        if kept is None:
            kept = united(value[:1], value[1:]) if isinstance(value, list) else [value] if rule == "first" and key == "aliases" else value
        elif rule == "first":
            if key == "aliases":
                kept = united(kept, value if isinstance(value, list) else [value])
            elif isinstance(kept, list) and isinstance(value, list):
                kept = united(kept, value)
        elif isinstance(kept, list):
            kept = united(kept, value if isinstance(value, list) else [value])
        elif isinstance(value, list):
            if rule == "promote":
                kept = united(kept, value)
            elif len(str(value)) > len(kept):
                kept = united(value[:1], value[1:])
        elif len(value) > len(kept):
            kept = value
    return kept


@pytest.mark.parametrize("rule", [properties.FIRST, properties.PROMOTE, properties.LONGEST])
def test_merge(spark, rule):
    choose = random.Random(rule)
    word = lambda: "".join(choose.choices("abc", k=choose.randrange(12)))
    value = lambda: choose.choice([None, "", [], word(), word(), [choose.choice("abcde") for _ in range(choose.randrange(1, 4))]])
    rows = [(i, pos, {k: value() for k in ("aliases", "name", "tags") if choose.random() < 0.8}) for i in range(150) for pos in range(choose.randrange(1, 6))]
    records = spark.createDataFrame([(i, pos, json.dumps(p)) for i, pos, p in rows], "id long, pos long, p string")
    records = records.select("id", "pos", F.from_json("p", "map<string,variant>").alias("properties"))
    out = properties.merge(properties.values(records), rule, ("aliases",) if rule == properties.FIRST else ()).collect()
    found = {(r["id"], r["key"]): r["values"] if r["many"] else r["values"][0] for r in out}
    want = {(i, k): folded([p.get(k) for j, _, p in rows if j == i], k, rule) for i in range(150) for k in ("aliases", "name", "tags")}
    assert len(out) == len(found) and found == {k: v for k, v in want.items() if v is not None}


def test_nothing(spark):
    none = spark.createDataFrame([(1, 0, None)], "id long, pos long, p string").select("id", "pos", F.from_json("p", "map<string,variant>").alias("properties"))
    assert properties.merge(properties.values(none), properties.PROMOTE).collect() == []
