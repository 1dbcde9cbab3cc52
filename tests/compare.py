"""Row sets of a query and of its SQL twin in DuckDB, made comparable."""

import math
from pathlib import Path

import duckdb


def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return float(value) if isinstance(value, (int, float)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark_frame, con, sql):
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(spark_frame.columns) == sorted(names)
    assert rows_of(spark_frame.columns, spark_frame.collect()) == rows_of(names, answer.fetchall())
