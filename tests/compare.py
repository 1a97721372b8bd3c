"""Row sets of Spark and DuckDB in one comparable form."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def database(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=str)
