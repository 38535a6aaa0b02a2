"""Compares a query with its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, float) and v == int(v):
            return int(v)
        return v.tolist() if hasattr(v, "tolist") else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def compare(spark, query, sql: str, folder: str = DATA) -> None:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    got, want = query(spark, folder).toPandas(), connection.sql(sql).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
