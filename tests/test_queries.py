"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from matchgrain.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("NULL" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SMALL).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_have_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
