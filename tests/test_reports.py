"""Named files by the data source writer: one a row, no more folders than tasks, attempts that don't count leave nothing."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia.operators import report
from marginalia.sources import files, reports


def test_many_reports(spark, tmp_path):
    df = spark.range(0, 3000, 1, 5).select(F.col("id").alias("doc_id"), F.lit("Team: é/x").alias("name"), F.concat(F.lit("# R"), F.col("id").cast("string")).alias("report"), F.lit(1).alias("n"))
    for _ in range(2):  # the second run replaces the first
        files.write_reports(df, str(tmp_path), "v")
    for kind in ("md", "json"):
        assert len(list((tmp_path / kind).iterdir())) <= 5 and len(list((tmp_path / kind).glob("*/*"))) == 3000
    assert next((tmp_path / "md").glob("*/Team_x_v_17.md")).read_text() == "# R17"
    assert json.loads(next((tmp_path / "json").glob("*/Team_x_v_17.json")).read_text()) == {"doc_id": 17, "name": "Team: é/x", "n": 1}
    files.write_reports(df.limit(0), str(tmp_path), "v")
    assert not list((tmp_path / "md").glob("*/*"))


@pytest.mark.parametrize("uri", [False, True])
def test_attempts(tmp_path, uri):
    writer = reports._Writer(f"file://{tmp_path}" if uri else str(tmp_path), True)
    rows = [Row(name="a.md", content="x"), Row(name="b.md", content=None)]
    writer.write(iter(rows))  # an attempt that is lost after it wrote
    counts = writer.write(iter(rows))
    writer.commit([counts, writer.write(iter([])), None])
    assert sorted(p.name for p in tmp_path.glob("*/*")) == ["a.md", "b.md"] and len(list(tmp_path.iterdir())) == 1
    again = reports._Writer(str(tmp_path), True)
    again.write(iter(rows))
    again.abort([None])
    assert sorted(p.name for p in tmp_path.glob("*/*")) == ["a.md", "b.md"]


def test_pass_report(spark):
    """Levels without case in one block, others last; a summary only where there is one; standing texts for what is missing."""
    rows = [(1, 3, "c", "third", "B", "low", None), (1, 1, "a", "first", "A", "Low", "Eve"), (1, 2, None, None, None, None, ""), (1, 4, "d", "fourth", "A", "HIGH", None), (2, 5, "e", "fifth", "A", "odd", None)]
    items = spark.createDataFrame(rows, "doc_id long, item_id long, title string, description string, category string, severity string, speaker string").withColumn("n", F.lit(1)).withColumn("form", F.lit("own"))
    told = spark.createDataFrame([(1, "All told.")], "doc_id long, summary string")
    made = lambda form: {r.doc_id: r.report for r in report.pass_report(items, "Issues", F.lit(form), told).collect()}
    got = made("priority")
    assert [x for x in got[1].split("\n") if x.startswith("#")] == ["# Issues", "## Summary", "## Categories", "## Identified items (4)", "### High priority items (1)", "#### d", "### Low priority items (2)", "#### a", "#### c", "### Items of other priority (1)", "#### Untitled item"]
    assert "- **A**: 2 items\n- **B**: 1 items\n- **Uncategorized**: 1 items" in got[1] and got[1].count("**Raised by**") == 1 and "No description provided." in got[1]
    assert "## Summary" not in got[2] and "### Items of other priority (1)" in got[2]
    assert [x for x in made("category")[1].split("\n") if x.startswith("### ")] == ["### A (2)", "### B (1)", "### Uncategorized (1)"]
    assert [x for x in made("flat")[1].split("\n") if x.startswith("### ")] == ["### a", "### Untitled item", "### c", "### d"]
    assert report.pass_report(items.limit(0), "Issues", F.lit("flat"), told).count() == 0
