"""Row comparison between a Spark result and the same query in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 6) + 0.0


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None when columns and rows (in any order) are equal."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {sorted(names)}"
    order = sorted(names)
    pick = [names.index(c) for c in order]
    expected = Counter(tuple(_cell(r[i]) for i in pick) for r in result.fetchall())
    got = Counter(tuple(_cell(r[c]) for c in order) for r in df.collect())
    if got == expected:
        return None
    return (f"{order}: {sum(got.values())} rows against {sum(expected.values())}; only spark "
            f"{list((got - expected).items())[:3]}; only sql {list((expected - got).items())[:3]}")
