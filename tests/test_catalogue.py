"""Every query with SQL agrees with it on the smallest dataset."""

import pytest

import __spark_entry__ as entry
from siftspark import catalog
from siftspark.operators import load_queries
from tests.oracle import DATA, connect, rows

SQL = catalog.oracle_sql() | load_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    query = (catalog.queries() | load_queries.queries())[name]
    got, want = query(spark, str(DATA / "sf0.001")).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_of_the_set_meets_all_members_of_its_cluster(spark, duck):
    got = catalog.queries()["v04_query_similarity"](spark, str(DATA / "sf0.001")).select("a", "b").toPandas()
    members = duck.sql(SQL["v04_query_similarity"].split("SELECT a.id AS a")[0] + "SELECT id, cluster_id FROM c").df()
    size = members.groupby("cluster_id")["id"].transform("size")
    want = {int(i): int(n) - 1 for i, n in zip(members["id"], size) if i % 20 == 0 and n > 1}
    assert want and got.groupby("a").size().to_dict() == want and (got["b"] % 20 != 0).any()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_import_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "siftspark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "siftspark.llm" not in path.read_text()
