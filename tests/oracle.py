"""Rows of a query and of its SQL in one comparable form."""

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, list | tuple | np.ndarray):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, decimal.Decimal | np.floating | float):
        return round(float(x), 9)
    if isinstance(x, np.bool_ | bool):
        return bool(x)
    if isinstance(x, np.integer):
        return int(x)
    if isinstance(x, pd.Timestamp | datetime.datetime):
        return str(pd.Timestamp(x).tz_localize(None))
    return x


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)
