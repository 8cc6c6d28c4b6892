"""Compare a Spark result with a DuckDB query over the same tables."""

from pathlib import Path

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(found) -> list:
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in found), key=str)


def same(df, sql: str, sf: str) -> None:
    names = sorted(df.columns)
    want = tables(sf).sql(sql)
    assert sorted(want.columns) == names
    assert rows(df.select(*names).collect()) == rows(want.select(", ".join(f'"{c}"' for c in names)).fetchall())
