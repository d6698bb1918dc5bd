"""Small literal frames for operators and their edge cases."""

import difflib

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import actions as A
from marginalia.operators import exchange as E
from marginalia.operators import similar as S
from marginalia.sources import files as IO
from marginalia.streaming.arrivals import ingest


def test_decode(spark):
    df = spark.createDataFrame([(1, "é".encode()), (2, "é".encode("latin-1")), (3, b"")], "i int, content binary")
    assert [r[0] for r in df.orderBy("i").select(IO.decode_text(F.col("content"))).collect()] == ["é", "é", ""]


def test_format(spark):
    rows = [("send it", None, None), ("send it", "Ann", "May 5"), ("ann: send by may 5", "Ann", "May 5")]
    df = spark.createDataFrame(rows, "t string, a string, d string")
    assert [r[0] for r in df.select(A.formatted(F.col("t"), F.col("a"), F.col("d"))).collect()] == ["send it", "Ann: send it (Due: May 5)", "ann: send by may 5"]


def test_prioritised(spark):
    rows = [(1, 0, 0, "a", None, "May", 4, 3), (1, 1, 0, "b", "Ann", None, 4, 3), (1, 2, 1, "c", None, None, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, idx long, group_id long, text string, assignee string, due string, score int, importance int")
    got = {r["idx"]: (r["assignee"], r["due"], r["rank"]) for r in A.prioritised(df).collect()}
    assert got == {2: (None, None, 1), 1: ("Ann", "May", 2)}


def test_leaders_and_ratio(spark):
    rows = [(1, 0, "send the report"), (1, 1, "send the reports"), (1, 2, "call Bob"), (1, 3, "")]
    df = spark.createDataFrame(rows, "doc_id long, idx long, text string")
    assert {r["idx"]: r["group_id"] for r in S.leader_groups(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    pairs = spark.createDataFrame([("abcd", "bcde"), ("", "")], "x string, y string")
    assert [r["ratio"] for r in S.exact_ratio(pairs).collect()] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("abcd", "bcde"), ("", ""))]


def test_dedupe_is_idempotent(spark, sf):
    from marginalia.views import load

    items = load(spark, sf, "items")
    rank = A.priority(F.col("severity"), {"High": 3, "Medium": 2, "Low": 1})
    once = S.deduped(items, rank).select(*items.columns)
    assert S.deduped(once, rank).count() == once.count() <= items.count()


def test_replies(spark):
    reply = '{"summary":"s","keywords":["k"],"speakers":[],"importance":5,"action_items":["x"],"key_quotes":[]}'
    df = spark.createDataFrame([(reply,), ("nothing",), ("S\nkeywords: a, b\nimportance: 2",)], "response string")
    a, b, c = (r[0] for r in df.select(E.parsed_annotation(F.col("response"))).collect())
    assert (a["summary"], a["importance"], a["keywords"]) == ("s", 5, ["k"])
    assert (b["summary"], b["importance"], b["keywords"]) == ("nothing", 3, [])
    assert (c["summary"], c["importance"], c["keywords"]) == ("S", 2, ["a", "b"])


def test_pending_uses_the_whole_text(spark):
    same = "x" * 1000
    df = spark.createDataFrame([(1, same + "a" + same), (2, same + "b" + same)], "doc_id long, text string")
    q = E.queued(df, F.col("text"), "doc_id")
    assert E.pending(q, q.where("doc_id = 1")).count() == 1


def test_likely(spark):
    df = spark.createDataFrame([("Ann: hi", None), ("plain", "about a call"), ("plain", "x")], "t string, s string")
    got = df.select(X.likely_transcript(F.col("t"), F.array(F.lit("A")), F.lit(None).cast("string"), F.col("s"))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox, table, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    ingest(spark, inbox, table, point)
    (tmp_path / "in" / "b.txt").write_text("two")
    ingest(spark, inbox, table, point)
    ingest(spark, inbox, table, point)
    assert sorted(r["text"] for r in spark.read.parquet(table).collect()) == ["one", "two"]


def test_catalog_and_outputs(spark, tmp_path):
    (tmp_path / "b.md").write_text("# My title\nx")
    (tmp_path / "c.txt").write_text("no heading")
    assert {r["title"] for r in IO.list_outputs(spark, str(tmp_path)).collect()} == {"My title", "c"}
