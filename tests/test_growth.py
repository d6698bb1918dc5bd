"""What a task holds and what is shuffled, on growing tables: parts of texts, counts in a row, batches in parts."""

import re
import time

import pytest
from marginalia.catalog import QUERIES
from marginalia.functions.breaks import BITS, blocks, cut_out, starts
from marginalia.functions.text import bound
from marginalia.operators import annotate as A
from marginalia.operators import apply as U
from marginalia.operators import topics as T
from marginalia.sources.reports import write_files
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["collection_prompts", "collection_report"])
def test_texts_of_collections_are_shuffled_once(spark, sf, name):
    assert plan(QUERIES[name](spark, sf)).count("Exchange hashpartitioning") == 1


def test_files_from_buffers(spark, tmp_path):
    write_files(spark.createDataFrame([("a", "é\n😀"), ("b", None), ("c", "")], "name string, content string"), str(tmp_path / "x"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "x").rglob("?")} == {"a": "é\n😀".encode(), "b": b"", "c": b""}
    with pytest.raises(Exception, match="a file without a name"):
        write_files(spark.createDataFrame([(None, "x")], "name string, content string"), str(tmp_path / "y"))


def test_items_come_in_parts(spark):
    df = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = U.map_items(df, lambda d: d.assign(n=len(d), size=d["text"].str.len())[["size", "n", "id"]], "id long, n long, size long").collect()
    assert sorted(r.id for r in got) == list(range(3000)) and {r.size for r in got} == {10_000}
    assert max(r.n for r in got) * 10_000 <= 2 * U.PART_BYTES


def test_terms_of_a_key_in_one_row(spark):
    rows = [(1, "The été cat, cat_1 cat9 CAT dog"), (1, "dog dog cat"), (2, None), (3, "a b"), (4, "zoo ant zoo")]
    df = T.top_terms(spark.createDataFrame(rows, "doc_id int, text string"), 2, ["the"])
    assert sorted(map(tuple, df.collect())) == [(1, "cat", 3, 1), (1, "dog", 3, 2), (4, "ant", 1, 2), (4, "zoo", 2, 1)]
    assert ", term" not in "".join(x for x in plan(df).splitlines() if "HashAggregate" in x)


def test_summary_in_its_row(spark):
    rows = [(1, 0, "Cats eat fish. Dogs bark. CATS eat mice! 12 34. Cats_x eat."), (1, 1, None), (2, 0, "1 2 3. a b."), (2, 1, "")]
    df = A.extractive_summary(spark.createDataFrame(rows, "doc_id int, chunk_index int, text string"), 2)
    assert "Exchange" not in plan(df) and "Join" not in plan(df)
    assert [tuple(r) for r in df.collect()] == [(1, 0, "Cats eat fish. Cats_x eat.")]  # eat 3; cats, eat: 2.5, fish: 1


def test_cut_out(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "\n" if i % 3 else "😀é"[i % 2] for i in range(3 * 2**BITS + 5))
    n, b = len(text), 2**BITS
    spans = [(0, 0), (0, 1), (0, n), (b - 1, b + 1), (b, b), (b, 2 * b), (5, 3), (2 * b - 3, n), (n - 1, n + 50), (n, n + 9), (n + b, n + b + 1), (17, 3 * b + 2)]
    df = spark.createDataFrame([(text, s, e) for s, e in spans], "text string, s int, e int")
    got = df.select("s", "e", bound(blocks(F.col("text")), lambda x: cut_out(x, F.col("s"), F.col("e"))).alias("x")).collect()
    assert all(r.x == text[r.s : max(r.s, r.e)] for r in got) and len(got) == len(spans)


def test_positions_in_runs(spark):
    """Positions are summed up in runs, so that no array is copied for every match; each pattern is looked for once in a text."""
    texts = [("ab. " * n + "é. Z",) for n in (0, 1, 31, 32, 33, 64, 500)] + [("none",), ("",), (None,)]
    df = spark.createDataFrame(texts, "text string").select("text", starts(F.col("text"), r"\.\s").alias("s"), starts(F.col("text"), r"\.\s", ends=True).alias("e"))
    for text, s, e in df.collect():
        found = list(re.finditer(r"\.\s", text or ""))
        assert (s, e) == ([m.start() for m in found], [m.end() for m in found])
    long = spark.range(1).select(F.repeat(F.lit("ab. "), 60_000).alias("text"))
    began = time.time()
    assert long.select(F.size(starts(F.col("text"), r"\.\s"))).first()[0] == 60_000
    assert time.time() - began < 20  # one array copied for every match: over a minute
    for name in ("strategy_metrics", "compare_strategies", "comparison_report"):
        made = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"split\(text#\d+, \(\?<=\[\.!\?\]\)\\s\+\(\?=\[A-Z\]\)", made)) == 1
