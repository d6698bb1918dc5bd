"""Chains of commitments and merge trees beyond what the queries' tables reach."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import annotate, commitments


def test_long_chain(spark):
    """A commitment kept over 40 periods, changed in every tenth: one chain, found by doubling pointers."""
    rows = [(1, p, 5, "send the quarterly report to the board " + "again " * (p // 10)) for p in range(40)]
    rows += [(1, p, 1, f"something else number {p * 7919} {chr(97 + p % 26) * 30}") for p in range(40)]
    rows += [(2, 7, 0, None), (2, 9, 0, ""), (2, 9, 1, "")]
    df = spark.createDataFrame(rows, "company_id long, period long, item long, text string").withColumn("g", F.lit(0))
    got = {(r["company_id"], r["period"], r["item"]): r for r in commitments.tracked(df).collect()}
    assert len(got) == len(rows)
    for p in range(40):
        r = got[1, p, 5]
        assert (r["chain_period"], r["chain_item"], r["dropped"]) == (0, 5, False)
        assert r["status"] == ("first" if p == 0 else "changed" if p % 10 == 0 else "kept")
        assert got[1, p, 1]["status"] == ("first" if p == 0 else "new") and got[1, p, 1]["dropped"] == (p < 39)
    # empty texts are alike; the smaller item is the mutual best
    assert (got[2, 9, 0]["status"], got[2, 9, 0]["previous_item"], got[2, 9, 1]["status"]) == ("kept", 0, "new")
    assert commitments.tracked(df.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [1, 40, 10_000])
def test_merge_tree(spark, budget):
    texts = {d: [f"{d}-{i} " * (1 + i % 5) for i in range(n)] for d, n in ((1, 1), (2, 2), (3, 37), (4, 64))}
    rows = [(d, i * 3, t) for d, ts in texts.items() for i, t in enumerate(ts)] + [(5, 0, None)]
    nodes = annotate.merge_tree(spark.createDataFrame(rows, "doc_id long, item long, text string"), budget, "|").collect()
    for d, ts in texts.items():
        mine = [r for r in nodes if r["doc_id"] == d]
        top = max(r["level"] for r in mine)
        roots = [r for r in mine if r["level"] == top]
        assert len(roots) == 1 and roots[0]["text"] == "|".join(ts) and (roots[0]["first"], roots[0]["last"]) == (0, len(ts) - 1)
        assert roots[0]["size"] == sum(map(len, ts))
        for level in range(1, top + 1):
            above, below = ([r for r in mine if r["level"] == k] for k in (level, level - 1))
            assert len(above) <= (len(below) + 1) // 2
            assert sorted(r["node"] for r in above) == list(range(len(above)))
    assert [(r["level"], r["text"]) for r in nodes if r["doc_id"] == 5] == [(0, "")]
