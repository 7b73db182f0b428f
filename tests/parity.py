"""Runs a query in Spark and its oracle in DuckDB and compares them."""

import duckdb

from weftline.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(table):
    names = sorted(table.column_names)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r.values()) for r in table.select(names).to_pylist()), key=str)


def kinds_of(table):
    return sorted((f.name, str(f.type).replace("large_", "")) for f in table.schema)


def compare(df, con, sql: str) -> int:
    ours, theirs = df.toArrow(), con.sql(sql).to_arrow_table()
    assert kinds_of(ours) == kinds_of(theirs)
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
