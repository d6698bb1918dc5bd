"""Strategies side by side: shares, totals, reports, plans."""

from marginalia.functions.breaks import sized
from marginalia.operators import divide as D
from marginalia.operators import strategies as S
from pyspark.sql import functions as F

WAYS = {"even": lambda t, n: D.even(t, n, 4, D.default_size(n, 4)), "sized": lambda t, n: D.by_size(t, n, 40)}
TEXT = "Anna: we start here. It is long enough to be cut.\nBert: a second thing follows. And a third one, too. The end is near. Now it is over."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics(spark):
    docs = spark.createDataFrame([(1, TEXT, 9), (2, "Short.", 9), (3, None, 9), (4, "", 9)], "doc_id long, text string, divisions int")
    got = {(r.doc_id, r.strategy): r for r in S.metrics(docs, WAYS).collect()}
    pieces = {k: docs.where("doc_id = 1").select(F.size(sized(F.col("text"), f))).head()[0] for k, f in WAYS.items()}
    most = max(pieces.values())
    assert most > 1 and all(got[1, k].divisions == n and abs(got[1, k].division_share - n / most) < 1e-8 for k, n in pieces.items())
    assert all(got[3, k][2:] == (False, 0, 0, 0.0, 0.0) for k in WAYS)
    for k in WAYS:
        mine = [r for (d, s), r in got.items() if s == k and d is not None]
        all_ = got[None, k]
        assert all_.total and len(mine) == 4 and all_.divisions == sum(r.divisions for r in mine) and abs(all_.length_share - sum(r.length_share for r in mine) / 4) < 1e-8
    assert S.metrics(docs.where("false"), WAYS).collect() == []
    assert plan(S.metrics(docs, WAYS)).count("Exchange") == 1


def test_report(spark):
    docs = spark.createDataFrame([(1, TEXT), (3, None)], "doc_id long, text string")
    df = S.comparison_report(docs, WAYS)
    assert "Exchange" not in plan(df)
    found = {r.doc_id: r.report for r in df.collect()}
    assert f"- Characters: {len(TEXT)}\n- Words: {len(TEXT.split())}\n- Speakers: 2" in found[1]
    assert "### Even strategy\nAnna: we start here" in found[1] and "| sized | " in found[1]
    assert found[3].count(S.NONE) == 2 and "- Characters: 0\n- Words: 0\n\n" in found[3]
