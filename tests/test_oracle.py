"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest
from conftest import SMALL
from oracle_check import connect, difference

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    assert difference(entry.queries()[name](spark, SMALL), duck, SQL[name]) is None


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, one", [("q_x2", "q_x2_linear_attribution"), ("q_x8", "q_x8_agent_text")])
def test_all_detectors_are_explained(spark, name, one):
    rows = entry.queries()[f"{name}_all_detectors"](spark, SMALL)
    of_one = entry.queries()[one](spark, SMALL)
    agent = "agent_5_rf_v1" if name == "q_x2" else "agent_7_unknown"
    counts = {r["agent"]: r["count"] for r in rows.groupBy("agent").count().collect()}
    assert len(counts) == 7 and set(counts.values()) == {of_one.count()}
    own = rows.filter(rows.agent == agent).select(*of_one.columns)
    assert own.exceptAll(of_one).count() == 0
