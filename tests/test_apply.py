"""User functions called from SQL: types found at analysis, own partitions and order, state over the rows of a group."""

import pytest
from pyspark.errors import AnalysisException

from marginalia.operators import apply as U


@pytest.fixture
def notes(spark):
    rows = [(1, i, f"t{i}", "x") for i in (4, 2, 0, 3, 1)] + [(2, 0, None, "y"), (2, 2, "late", None), (None, 7, "n", "z"), (3, None, "b", "z"), (3, None, "a", "z")]
    spark.createDataFrame(rows, "doc_id long, item long, text string, extra string").createOrReplaceTempView("notes_udtf")
    U.register(spark, "merged_udtf", U.sql_level(",".join))
    U.register(spark, "words_udtf", U.sql_function(lambda t: [(w,) for w in (t or "").split()], "word string", "text"))


def test_groups(spark, notes):
    got = {tuple(r) for r in spark.sql("SELECT * FROM merged_udtf(TABLE(notes_udtf), 2)").collect()}
    assert got == {(1, 0, 2, "t0,t1"), (1, 1, 2, "t2,t3"), (1, 2, 1, "t4"), (2, 0, 1, ""), (2, 1, 1, "late"), (None, 3, 1, "n"), (3, None, 2, "a,b")}
    assert spark.sql("SELECT * FROM merged_udtf(TABLE(SELECT * FROM notes_udtf WHERE false), 2)").collect() == []
    nested = spark.sql("SELECT * FROM merged_udtf(TABLE(SELECT doc_id, item, text FROM merged_udtf(TABLE(notes_udtf), 2) WHERE doc_id = 1), 9)").collect()
    assert [tuple(r) for r in nested] == [(1, 0, 3, "t0,t1,t2,t3,t4")]


def test_same_as_frames(spark, notes):
    spark.range(200).selectExpr("id % 7 AS doc_id", "id DIV 7 AS item", "concat('v', id) AS text").createOrReplaceTempView("many_udtf")
    a = spark.sql("SELECT doc_id, item, text FROM merged_udtf(TABLE(many_udtf), 3)").collect()
    b = U.level_functions(spark.table("many_udtf").withColumnRenamed("item", "chunk_index"), [(3, lambda g: ",".join(g["text"]))])
    assert sorted(map(tuple, a)) == sorted((r.doc_id, r["item"], r.text) for r in b.collect())


def test_rows(spark, notes):
    got = spark.sql("SELECT * FROM words_udtf(TABLE(SELECT 5 AS k, 'a b' AS text UNION ALL SELECT 6, NULL))")
    assert got.columns == ["k", "text", "word"] and sorted(map(tuple, got.collect())) == [(5, "a b", "a"), (5, "a b", "b")]


@pytest.mark.parametrize("call", ["merged_udtf(TABLE(notes_udtf), 0)", "merged_udtf(TABLE(SELECT 1 AS item), 2)", "words_udtf(TABLE(SELECT 'x' AS text, 1 AS word))"])
def test_refused(spark, notes, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}").collect()
