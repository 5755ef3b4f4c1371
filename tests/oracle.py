"""Comparison of a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def text(value):
    if value is None or isinstance(value, bool | int | str):
        return repr(value)
    if isinstance(value, float):
        return format(value, ".9g")
    return str(value)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted([text(v) for v in row] for row in df.select(*columns).collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted([text(row[i]) for i in order] for row in found.fetchall())
