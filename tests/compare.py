"""Rows of a query against those of its SQL in DuckDB, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def same(df, con, sql):
    got = df.toArrow()
    want = con.execute(sql).fetch_arrow_table() if hasattr(con, "fetch_arrow_table") else con.sql(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = [sorted(tuple(plain(v) for v in r) for r in zip(*(t.column(n).to_pylist() for n in names), strict=True)) for t in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
