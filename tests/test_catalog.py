"""Every registered query beside its SQL, on whole tables of the smallest scale."""

import math

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect

QUERIES, SQL = queries(), oracle_sql()
# Many-round samplers: test_planning.py has their small cases, check_oracles.py runs them here too.
LONG = {"n4_depth_first", "n8_training_samples", "n9_size_buckets"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LONG])
def test_query_matches_sql(spark, sf, con, name):
    rows = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert compare(rows, con.execute(SQL[name]).df()) == ""
    else:
        assert len(rows)
    if name == "f1_trained_classifier":
        assert rows["auroc"][0] > 0.9


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_spectral_discrepancy_is_a_distance(spark, sf):
    rows = QUERIES["g16_spectral_mmd"](spark, sf).collect()
    assert rows and all(0 <= r["mmd"] < 2 and math.isfinite(r["mmd"]) for r in rows)


def test_entry(spark):
    assert entry(spark).count() == 1
