"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def read_spark(df: DataFrame) -> pd.DataFrame:
    return df.toArrow().to_pandas()


def read_duck(con: duckdb.DuckDBPyConnection, sql: str) -> pd.DataFrame:
    return con.execute(sql).fetch_df()


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for name in sorted(frame.columns):
        column = frame[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            out[name] = column.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(column):
            out[name] = column.astype(object).astype(str)
        elif pd.api.types.is_numeric_dtype(column):
            out[name] = column.astype("float64")
        else:
            out[name] = column.astype(object).where(column.notna(), "<null>").astype(str)
    table = pd.DataFrame(out)
    return table.sort_values(list(table.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs first. Values must match exactly, as a hash would ask."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = _normal(got), _normal(want)
    for name in a.columns:
        x, y = a[name].to_numpy(), b[name].to_numpy()
        if a[name].dtype != b[name].dtype:
            return f"{name}: {a[name].dtype} vs {b[name].dtype} {x[:2]} {y[:2]}"
        if x.dtype == np.float64:
            same = (x == y) | (np.isnan(x) & np.isnan(y))
        else:
            same = x == y
        if not same.all():
            at = int(np.argmin(same))
            return f"{name}: {int((~same).sum())} differ, first at {at}: {x[at]!r} vs {y[at]!r}"
    return None
