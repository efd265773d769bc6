"""Compares a query with its SQL in DuckDB over the driver's tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


def same(spark, con, folder, run, sql):
    ours, theirs = run(spark, folder).toPandas(), con.execute(sql).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
