"""The registered queries against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    out = db.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in out.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    same = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert same(df.select(*cols).collect()) == same(out.fetchall())
