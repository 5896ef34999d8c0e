"""Run a registered query and its SQL twin on the same tables and compare them exactly."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "huge",
         "double": "double", "float": "float", "string": "string", "varchar": "string", "boolean": "bool"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is not None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short reason."""
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    types = {n: str(t).lower() for n, t in zip(names, [c[1] for c in rel.description])}
    diff = []
    for f in df.schema.fields:
        a, b = f.dataType.simpleString(), types[f.name]
        if "array" in a or "[]" in b or "struct" in a:
            continue
        if KINDS.get(a, a) != KINDS.get(b, b):
            diff.append(f"{f.name}: {a} vs {b}")
    want = sorted([tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()], key=key)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=key)
    if diff:
        return f"types {diff}"
    if len(want) != len(got):
        return f"rows {len(got)} vs {len(want)}; {got[:2]} vs {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ on {cols}: {bad[:2]}"
    return None
