"""Every query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v
    return [names[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in plans.oracle_sql():
        assert got[1]
        return
    cur = duck.execute(plans.oracle_sql()[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
