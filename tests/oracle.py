"""Compare a Spark result with DuckDB's on the same tables."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(path: str = DATA):
    con = duckdb.connect()
    for t in os.listdir(path):
        where = f"{path}/{t}/*.parquet" if os.path.isdir(f"{path}/{t}") else f"{path}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{where}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)
