from __future__ import annotations

import pytest

import __spark_entry__ as entry
from barloom import queries as own
from oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(own.QUERIES[name](spark, sf_dir).toPandas(), con.execute(own.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert own.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) <= set(entry.queries())


def test_bootstrap_and_bagging_take_every_bar(spark, sf_dir):
    bars = {r.series_id: r["count"] for r in own.hourly(spark, sf_dir).groupBy("series_id").count().collect()}
    drawn = own.QUERIES["sequential_bootstrap"](spark, sf_dir).toPandas()
    assert drawn.groupby(["series_id", "bag"])["times"].sum().to_dict() == {(s, k): n for s, n in bars.items() for k in range(4)}
    judged = own.QUERIES["sequential_bagging"](spark, sf_dir).groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in judged} == {s: n - 8 for s, n in bars.items() if n > 8}


def test_every_bar_opens_an_event(spark, sf_dir):
    bars = own.hourly(spark, sf_dir)
    want = sum(max(0, r["count"] - 8) for r in bars.groupBy("series_id").count().collect())
    assert own.QUERIES["average_uniqueness_every_bar"](spark, sf_dir).count() == want
    assert own.QUERIES["cv_paths_all_series"](spark, sf_dir).first()["rows"] == bars.count()
