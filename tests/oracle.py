"""Compare registered queries with their SQL in DuckDB: names, types and all values."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame, types as T

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

KINDS = {
    T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN", T.FloatType: "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; an empty list means equal names, types and rows."""
    expected = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in expected.description}
    mine = {f.name: KINDS.get(type(f.dataType), f.dataType.simpleString()) for f in result.schema.fields}
    found = []
    if sorted(kinds) != sorted(mine):
        return [f"columns {sorted(mine)} vs {sorted(kinds)}"]
    found += [f"type of {c}: {mine[c]} vs {kinds[c]}" for c in sorted(kinds) if mine[c] != kinds[c]]
    columns = sorted(kinds)
    at = [list(kinds).index(c) for c in columns]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in expected.fetchall())
    ours = sorted(tuple(_plain(r[c]) for c in columns) for r in result.select(
        *[f"`{c}`" for c in columns]).collect())
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first {bad[0]}")
    return found
