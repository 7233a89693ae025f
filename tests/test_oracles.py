"""Every registered query of the library's own operators against its DuckDB SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import types as T

from weft.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def whole(df):
    """df in pandas, integers with nulls as such: toPandas() alone would make them floats."""
    out = df.toPandas()
    return out.astype({f.name: "Int64" for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType)) and out[f.name].hasnans})


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, db, name):
    got = whole(catalog.QUERIES[name](spark, DIR))
    want = db.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql_runs_and_repeats(spark, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert rows(got) == rows(catalog.QUERIES[name](spark, DIR).toPandas())
