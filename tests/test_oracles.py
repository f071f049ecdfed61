"""Every query with checking SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from spanweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) or v != v else round(v, 6) if isinstance(v, float) else v
    out = [tuple(clean(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_ratio_of_odd_keys(spark, tmp_path):
    """A total of 0 is infinite whatever its part, a null or one below 1 too."""
    c, keys = duckdb.connect(), [(None, 11), (None, 5), (7, None), (-1, 0), (-3, 11), (-3, -4), (5, 22)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["float_ratio"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, c.sql(registry.ORACLES["float_ratio"]).fetchall()))
