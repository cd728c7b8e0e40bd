"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype(int)
        elif not pd.api.types.is_numeric_dtype(frame[c]):
            frame[c] = frame[c].map(lambda x: x if x is None or isinstance(x, str) else str(x))
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs first, or None."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} and {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} and {len(expected)} rows"
    a, b = _plain(got), _plain(expected)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            k = int((~same).idxmax())
            return f"column {c}, row {k}: {a[c][k]!r} and {b[c][k]!r} ({int((~same).sum())} rows)"
    return None
