"""Every engine query against its SQL, on the smallest tables."""

import os

import pytest

from strandline.plans import queries

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels".split()


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db(request):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(db.sql(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
