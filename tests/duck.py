"""Compare a DataFrame with the rows of DuckDB SQL over the same tables."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    found = con.execute(sql)
    expected = canonical([c[0] for c in found.description], found.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1]
