"""Compare a Spark result with DuckDB SQL over the same tables, as bags of rows."""

import math
import os
from glob import glob

import duckdb


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def assert_same(df, sql, sf_dir, **views):
    c = connect(sf_dir) if sf_dir else duckdb.connect()
    for name, rel in views.items():
        c.register(name, rel)
    cursor = c.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(columns, cursor.fetchall())
