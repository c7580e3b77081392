"""Every registered query against its SQL oracle in DuckDB, over the smallest test data."""

import duckdb
import pytest
from metaloom.plans import register

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf, columns):
    plain = lambda x: None if x is None else round(float(x), 6) if isinstance(x, (int, float)) else str(x)
    known = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(str(tuple(map(plain, r))) for r in known.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(register.QUERIES))
def test_query(spark, duck, name):
    got = register.QUERIES[name](spark, SF).toPandas()
    if name in register.ORACLE_SQL:
        want = duck.execute(register.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
