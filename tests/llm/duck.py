"""Rows of a DuckDB query over Parquet tables or small pandas tables."""

import duckdb


def rows(sql, sf=None, **tables):
    con = duckdb.connect()
    if sf:
        for name in ("documents", "pages", "labels", "benchmark"):
            con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    for name, frame in tables.items():
        con.register("_" + name, frame)
        con.execute(f"create or replace view {name} as select * from _{name}")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
