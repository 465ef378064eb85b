import duckdb
import pytest

from rillwork import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()]
    got = [tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_query_runs(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
