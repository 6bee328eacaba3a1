import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(got, want) -> bool:
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda d: sorted(repr([round(float(x), 6) if isinstance(x, float) else x if x == x else None for x in row]) for row in d[columns].astype(object).values.tolist())
    return plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_against_sql(spark, con, name):
    assert same(entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
