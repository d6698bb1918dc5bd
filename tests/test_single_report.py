"""The report of a single document on odd rows: repeated and missing ids, null and blank texts, white space, letters."""

import duckdb
from marginalia.catalog import QUERIES, SQL

LONG = "One two three with four. " * 400
SAID = ["come with ", "come with\x85. Then x", "come\x0bwith\x0bme", "a.\x0bwith b", "go WİTH me", "\x0b- a\nx", "-\x0ba\nfor b", "come with\r\n", "- a\n\n* b"]
BLANK = [None, "", "   ", "\n\n", "\x0b", " " * 9000, "\x0b" * 12000, "a. " + "\x0b" * 12000 + "b"]


def test_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*SAID, *BLANK, LONG])]
    rows += [(100, LONG), (100, "short"), (101, "q with"), (101, "q with"), (102, None), (102, "b"), (103, ""), (103, LONG), (None, LONG), (None, "x with y")]
    df = spark.createDataFrame([(i, t, "en" if k % 5 else None, "s" if k % 7 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    given = sorted(c.execute(SQL["single_report"]).fetchall(), key=repr)
    assert sorted((tuple(r) for r in QUERIES["single_report"](spark, str(tmp_path)).collect()), key=repr) == given
    assert len(given) == len(rows) and sum("- Divisions: 4\n" in r for i, r in given if i == 100) == 2


def test_texts_are_not_shuffled(spark, sf):
    plan = QUERIES["single_report"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
