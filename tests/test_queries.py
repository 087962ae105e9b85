"""Every graph query gives what its SQL gives, on the smallest tables."""

import math

import duckdb
import pytest

from skeinwork import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else round(v, 9) if isinstance(v, float) and v % 1 else int(v) if isinstance(v, float) else v

    return sorted((tuple(str(plain(v)) for v in r) for r in frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
