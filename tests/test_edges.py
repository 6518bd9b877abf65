"""Defined results for null, empty and clashing input of the core operators that have no test of their own."""

from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.functions.words import words
from siftspark.operators import vector
from siftspark.operators.skew import placement
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut


def test_words():
    assert words(None) == words("") == words(" \n") == []
    assert words("It's 2x FASTER—é") == ["it", "s", "2x", "faster"]
    assert len(words("a " * 100_000)) == 100_000


def test_text_expressions_take_nulls(spark):
    df = spark.createDataFrame([(None, None, "clash"), ("A", "", ""), ("Broken", None, "x")], "title string, body string, text string")
    got = [r[0] for r in df.select(X.whole_text()).collect()]
    assert got == [" ", "a ", "broken "]
    assert [r[0] for r in df.select(X.word_count(X.whole_text())).collect()] == [0, 1, 1]
    assert [r[0] for r in df.select(X.joined("|", "title", "body")).collect()] == ["", "A", "Broken"]
    assert [r[0] for r in df.select(X.ellipsis(F.col("title"), 5)).collect()] == [None, "A", "Br..."]


def test_placement_of_an_empty_table(spark):
    assert placement(spark.createDataFrame([], "k string"), "k", tasks=4).shards == {}


def test_bounded_hints_only_small_sides(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(bounded(spark.range(5), 10)) and not hinted(bounded(spark.range(50), 10))


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0], None)], "a int, b array<double>, c string")
    assert cut(df).schema == df.schema and cut(df).collect() == df.collect() and cut(df.limit(0)).count() == 0


def test_centroids_with_nulls_and_uneven_vectors(spark):
    df = spark.createDataFrame([("g", [1.0, 2.0]), ("g", [3.0]), (None, [1.0]), ("h", None)], "k string, v array<double>")
    got = {(r["k"], r["d"]): r["mean"] for r in vector.centroids(df, "k", "v").collect()}
    assert got == {("g", 0): 2.0, ("g", 1): 2.0, (None, 0): 1.0}
