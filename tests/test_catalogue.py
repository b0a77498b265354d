"""Every catalogue query against its SQL in DuckDB, as the driver compares them."""

import pytest

from stratadoc.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{SF}/{t}.parquet') else ''}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if r[i] is None else repr(r[i].replace(tzinfo=None)) if hasattr(r[i], "tzinfo") else repr(r[i]) for i in order) for r in rows), sorted(names)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    duck.execute(catalogue.oracle_sql()[name])
    want = plain(duck.fetchall(), [d[0] for d in duck.description])
    assert got[1] == want[1]
    assert got[0] == want[0], (len(got[0]), len(want[0]), got[0][:3], want[0][:3])
