"""Every registered query of the library on the smallest tables, against its SQL."""

import os

import duckdb
import pytest

from meshwright.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert sorted_rows(df.columns, got) == sorted_rows(want.columns, want.fetchall())
    else:
        assert got
