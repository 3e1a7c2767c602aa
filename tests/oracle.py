"""Compare a query with its SQL over the same Parquet tables."""

from pathlib import Path

import duckdb
import pytest

DIRECTORY = "/root/testdata/sf0.001"


def connection():
    if not Path(DIRECTORY).exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for path in Path(DIRECTORY).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, float) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return [tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]


def agrees(spark, query, sql):
    got, want = query(spark, DIRECTORY).toPandas(), connection().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))
