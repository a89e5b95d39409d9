"""A query's rows beside its SQL twin's, as the driver compares them."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    norm = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], plain([[r[i] for i in order] for r in rel.fetchall()])


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, plain(tuple(r) for r in df.select(*columns).collect())
