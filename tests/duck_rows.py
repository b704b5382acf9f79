"""Comparison of a DataFrame with DuckDB over the same Parquet tables."""

import os


def compare(df, sql: str, sf_dir: str) -> None:
    """Rows of ``df`` and of DuckDB agree, columns by name, rows in any order."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (bool, int, str, list, type(None))) else str(v)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
