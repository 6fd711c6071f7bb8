"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import lodeplane.plans as plans
from lodeplane.plans.registry import with_views

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, str):
        return x
    if type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    return round(float(x), 6)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, DIR).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_operator_of_the_survey_is_registered():
    counts = {"src": 15, "snk": 9, "flt": 27, "prj": 4, "jon": 24, "agg": 31, "win": 15, "srt": 12, "set": 5, "fn": 29, "lc": 5, "gc": 7, "pm": 7, "st": 10}
    assert not {f"{k}{i:02d}" for k, n in counts.items() for i in range(1, n + 1)} - set(plans.QUERIES)


def test_views_are_prefixed_with_what_they_need():
    sql = with_views("SELECT * FROM latest")
    assert sql.index("meta AS") < sql.index("versions AS") < sql.index("live AS") < sql.index("latest AS (")
