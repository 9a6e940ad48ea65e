"""Every query against its SQL on sf0.01; those without SQL must give rows with a stable schema."""

import duckdb
import pandas as pd
import pytest

from varistrata.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    names = sorted(df.columns)

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    want = duck.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0 and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
