import duckdb
import pytest

from tessella.plans import catalog, remesh, scenes  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 3) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = duck.sql(catalog.ORACLE_SQL[name])
    names = rel.columns
    assert sorted(names) == columns
    assert mine == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
