"""Every query with a DuckDB twin against it, on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import inventory

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows):
    said = lambda v: "" if v is None else str(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(said, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(inventory.QUERIES))
def test_query(spark, duck, name):
    df = inventory.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows_of(df.select(columns).collect())
    if name in inventory.ORACLE_SQL:
        cur = duck.execute(inventory.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        assert got == rows_of([tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()])
