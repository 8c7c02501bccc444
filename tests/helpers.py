"""Comparison of a registered query with its SQL on a data folder."""

import math
from collections import Counter
from pathlib import Path

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.8g}")
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(norm(x) for x in r) for r in df.select(*cols).collect())


def sql_rows(sql, folder=DATA):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cols = sorted(con.sql(sql).columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    return cols, Counter(tuple(norm(x) for x in r) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
