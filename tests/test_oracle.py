"""Each query of the reference's operators against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from labelmatch.plans import catalog, exchange, matching, recognition, text

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(name, plans) for plans in (recognition, text, matching, catalog, exchange) for name in plans.SQL]


@pytest.fixture(scope="module")
def duck():
    if not Path(SMALL).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize(("name", "plans"), CASES, ids=[c[0] for c in CASES])
def test_query_equals_sql(spark, duck, name, plans):
    df = plans.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(row[c]) for c in names)) for row in df.collect())
    found = duck.sql(plans.SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(row[i]) for i in at)) for row in found.fetchall())
