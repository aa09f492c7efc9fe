"""Each registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from tabforge import queries

SF = "/root/testdata/sf0.001"
queries.load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.SQL:
        assert len(got.collect()) >= 0 and got.columns
        return
    want = con.execute(queries.SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    rows = lambda rs: sorted(str(tuple(map(plain, r))) for r in rs)
    assert rows(got.select(*(f"`{c}`" for c in order)).collect()) == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 13
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
