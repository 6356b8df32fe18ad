"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

from veritrace.sources.sample import TABLES


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    return value


def normalized(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, queries, oracles, sf_dir):
    """None if equal, otherwise a description of the difference."""
    df = queries[name](spark, sf_dir)
    got = normalized([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(oracles[name])
    columns = [d[0] for d in rel.description]
    want = normalized(rel.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}: only ours {[r for r in got if r not in set(want)][:2]} only theirs {[r for r in want if r not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}"
    types = [(a, b) for r, s in zip(got, want) for a, b in zip(r, s) if type(a) is not type(b)]
    return f"types differ: {types[0]}" if types else None
