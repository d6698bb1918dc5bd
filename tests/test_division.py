"""Properties of the division folds; their rows are compared with SQL in test_oracles."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions.breaks import sized, starts
from marginalia.operators import divide as D
from marginalia.views import load


def finds(pattern, text):
    return [m.start() for m in re.finditer(pattern, text)]


def factor(size, target):
    """Weight of a break by the size of the section that it would close."""
    bands = [(1.2, 0.8 <= size / target <= 1.2), (0.8, size / target < 0.5), (0.7, size / target > 1.5)]
    return next((w for w, fits in bands if fits), 1.0)


def got(df, column):
    return {r["doc_id"]: (r["text"], [(x["s"], x["e"]) for x in r["p"]]) for r in df.select("doc_id", "text", column.alias("p")).collect()}


def test_context(spark, sf):
    """Every section ends at the break of most weight in its reach, or has none in reach."""
    rows = got(load(spark, sf, "dossiers"), sized(F.col("text"), lambda t, n: D.context_aware(t, n, 2, 1000)))
    for text, pieces in rows.values():
        target = len(text) / max(2, -(-len(text) // 4000))
        breaks = sorted((x, k, w) for k, (p, w) in enumerate(D.CONTEXT) for x in finds(p, text))
        for start, end in pieces:
            beyond = [i for i, b in enumerate(breaks) if b[0] > start + 1.5 * target]
            reach = [(i, b) for i, b in enumerate(breaks[: beyond[0] + 1] if beyond else breaks) if b[0] > start and b[0] - start >= max(1000, target // 3)]
            if reach:
                assert end == max((b[2] * factor(b[0] - start, target), -i, b[0]) for i, b in reach)[2]
            else:
                assert end == len(text) or end - start <= target


@pytest.mark.parametrize("name", ["even", "structural", "by_turns"])
def test_cover(spark, sf, name):
    rule = lambda t, n: getattr(D, name)(t, n, 3, D.default_size(n, 3))
    for text, pieces in got(load(spark, sf, "dossiers"), sized(F.col("text"), rule)).values():
        assert "".join(text[a:b] for a, b in pieces) == text


@pytest.mark.parametrize("rule", [D.by_speakers, D.by_topics, lambda t, n: D.by_size(t, n, 700), lambda t, n: D.teams(t, n, 700)])
def test_whole_text(spark, sf, rule):
    for view in ("transcripts", "teams_transcripts"):
        for text, pieces in got(load(spark, sf, view), sized(F.col("text"), rule)).values():
            assert "".join(text[a:b] for a, b in pieces) == text


def test_starts(spark):
    texts = ["", "a", "\n\nx\n\ny", "A: b\nCc: d", "é\nß\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in (r"\n", r"\n\s*\n", r"(^|\n)[A-Z][a-z]*:"):
        assert [r[0] for r in df.select(starts(F.col("text"), p)).collect()] == [finds(p, t) for t in texts]


def test_paragraphs(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(80))
    df = spark.createDataFrame([(f"  one \n\n\n two\n \n{long}",)], "text string")
    found = df.select(D.paragraphs(F.col("text"))).first()[0]
    assert found[:2] == ["one", "two"] and len(found) > 3
    assert " ".join(found[2:]) == long and all(len(x) <= 1100 for x in found)


def test_labels(spark):
    df = spark.createDataFrame([(n, i) for n in range(1, 12) for i in range(n)], "doc_id int, chunk_index int")
    rows = D.position_labels(df).collect()
    for n in range(2, 12):
        mine = [r["position"] for r in sorted((r for r in rows if r["doc_id"] == n), key=lambda r: r["chunk_index"])]
        assert mine[0] == "introduction" and mine[-1] == "conclusion" and mine.count("introduction") == mine.count("conclusion") == 1
