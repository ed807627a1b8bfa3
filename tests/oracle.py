"""Compare a Spark result with DuckDB's answer, regardless of row order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def answer(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def norm(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return tuple(map(norm, value)) if isinstance(value, (list, tuple)) else value


def same(df, sql: str, sf_dir: str = SF) -> None:
    names, rows = answer(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
