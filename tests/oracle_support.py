"""Runs a query and its SQL over the same tables and compares the rows as multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return _plain(value.item()) if hasattr(value, "item") else value


def compare(spark, run, sql: str, sf_dir: str) -> None:
    with duckdb.connect() as base:
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = base.sql(sql)
        columns = sorted(found.columns)
        at = [found.columns.index(c) for c in columns]
        want = Counter(tuple(_plain(r[k]) for k in at) for r in found.fetchall())
    df = run(spark, sf_dir)
    assert sorted(df.columns) == columns
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == want
