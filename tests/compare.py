"""Holds a query's rows against those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if columns and rows are equal."""
    con = duckdb.connect()
    for name in NAMES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want, have = _rows(names, cur.fetchall()), _rows(df.columns, [tuple(r) for r in df.collect()])
    if want != have:
        return f"{len(have)} against {len(want)} rows; first: {next(((a, b) for a, b in zip(have, want) if a != b), None)}"
    return ""
