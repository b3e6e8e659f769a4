"""Every query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from emberline.plans.catalog import QUERIES
from emberline.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canon(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or not isinstance(v, float) and not hasattr(v, "as_tuple"):
            return v
        return float(f"{float(v):.9g}")

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    want = canon(tuple(r[i] for i in order) for r in cursor.fetchall())
    assert canon(tuple(r) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
