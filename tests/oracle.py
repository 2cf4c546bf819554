"""Compare a query with its SQL, run by DuckDB on the same files."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())
