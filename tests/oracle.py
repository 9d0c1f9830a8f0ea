"""Run a registered query and its SQL side by side and compare the results exactly."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def _cell(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def compare(spark, con, fn, statement: str, sf_dir: str) -> dict:
    """Outcome of one comparison: rows, equality, type differences, seconds."""
    t0 = time.time()
    left = fn(spark, sf_dir).toArrow()
    t1 = time.time()
    right = con.execute(statement).to_arrow_table()
    t2 = time.time()
    out = {"rows": left.num_rows, "oracle_rows": right.num_rows, "spark_sec": round(t1 - t0, 2),
           "oracle_sec": round(t2 - t1, 2), "equal": False, "note": ""}
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        out["note"] = f"columns {names} vs {sorted(right.column_names)}"
        return out
    kinds = [f"{c}: {left.schema.field(c).type} vs {right.schema.field(c).type}" for c in names
             if left.schema.field(c).type != right.schema.field(c).type]
    kinds = [k for k in kinds if "timestamp" not in k and "list" not in k]
    rows = [sorted((tuple(_cell(v) for v in row) for row in zip(*[t[c].to_pylist() for c in names], strict=True)),
                   key=_key) for t in (left, right)]
    out["equal"] = rows[0] == rows[1]
    out["types"] = kinds
    if not out["equal"]:
        bad = [(a, b) for a, b in zip(*rows) if a != b][:2]
        out["note"] = f"{names} {bad}"
    return out
