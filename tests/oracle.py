"""Runs a query and its SQL over the same tables and compares the rows."""

from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def same(spark, name, queries, sql, data=DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = queries[name](spark, str(data))
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*sorted(df.columns)).collect())
    cursor = con.execute(sql[name])
    columns = [c[0] for c in cursor.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())
