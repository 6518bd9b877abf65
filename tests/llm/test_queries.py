import pytest

from siftspark.llm import queries as Q
from tests.oracle import DATA, connect, rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    got = Q.queries()[name](spark, str(DATA / "sf0.001")).toPandas()
    want = connect(DATA / "sf0.001").sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["p1_clusters", "p2_found", "p3_found", "p10_composition"])
def test_runs_on_whole_tables(spark, name):
    assert Q.queries()[name](spark, str(DATA / "sf0.001")).count() >= 0
