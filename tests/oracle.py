"""Holding a query's rows against its SQL, as DuckDB runs it on the same tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, query, sql):
    if not Path(SF).exists():
        pytest.skip("the tables are not here")
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.sql(sql).to_arrow_table()
    got = query(spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    key = lambda r: tuple(repr(r[n]) for n in names)
    assert sorted(map(key, got.to_pylist())) == sorted(map(key, want.to_pylist()))
    assert {n: str(got.schema.field(n).type) for n in names} == {n: str(want.schema.field(n).type) for n in names}
