"""Side-by-side check of registered queries against their DuckDB oracles."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 9)
    return v


def kind(dtype):
    d = str(dtype).lower()
    for name, words in {"int": ("bigint", "int", "long", "hugeint"), "float": ("double", "float", "decimal"), "bool": ("bool",)}.items():
        if any(w in d for w in words):
            return name
    return "text"


def run_pair(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: kind(d[1]) for d in rel.description}
    rows = rel.fetchall()
    if sorted(names) != cols:
        return len(got), f"columns {cols} != {sorted(names)}"
    types = {c: kind(t) for c, t in df.dtypes}
    if types != kinds:
        return len(got), f"types {[(c, types[c], kinds[c]) for c in cols if types[c] != kinds[c]]}"
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in idx) for r in rows), key=repr)
    if got == want:
        return len(got), None
    a, b = set(map(repr, got)), set(map(repr, want))
    return len(got), f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only oracle {sorted(b - a)[:3]}"
