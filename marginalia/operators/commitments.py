"""Commitments of a company followed over its periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .similar import near, normalised


def heads(links: DataFrame) -> DataFrame:
    """(g, node, head) of chains of (g, node, to): each step joins every pointer to that of its end, so
    that pointers double in length until all end at a head."""
    now = links.select("g", "node", F.col("to").alias("head"))
    while True:
        further = now.select("g", F.col("node").alias("head"), F.col("head").alias("beyond"))
        now = cut(now.join(further, ["g", "head"], "left"), "chains")
        moved = now.where("beyond is not null").head(1)
        now = now.select("g", "node", F.coalesce("beyond", "head").alias("head"))
        if not moved:
            return now


def tracked(items: DataFrame, threshold: float = 0.7, by: str = "company_id", period: str = "period", item: str = "item", text: str = "text") -> DataFrame:
    """Each commitment (by, period, item, text) with ``previous_item``, its ``ratio`` to it, ``status``, ``dropped`` and
    the ``chain_period``, ``chain_item`` that its chain begins with.

    Commitments of two successive periods of a company are linked where each is the other's most alike,
    with normalised texts more alike than the threshold; ties go to the smaller item. Status: ``first`` in the
    company's first period, ``kept`` with an equal text, ``changed`` with another, ``new`` without an earlier one; dropped: not in
    the company's last period and without a later one. Null texts count as empty. Items are unique in a period.
    """
    rows = items.select(F.col(by).alias("g"), F.col(period).alias("period"), F.col(item).cast("long").alias("item"), F.coalesce(normalised(F.col(text)), F.lit("")).alias("x"))
    periods = rows.select("g", "period").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("period")).cast("long"))
    periods = periods.withColumn("last", F.max("rank").over(Window.partitionBy("g")))
    known = cut(rows.join(periods, ["g", "period"]), "commitments")
    pair = F.explode(F.array(F.col("rank"), F.col("rank") - 1))  # of a period with its next and with the one before
    both = known.select("g", pair.alias("pair"), F.struct("rank", "item", F.length("x").cast("long").alias("n")).alias("id"), F.array("x").alias("texts"))
    both = both.select(F.struct("g", "pair").alias("g"), "id", "texts")
    longer = F.greatest("a.n", "b.n", F.lit(1))
    found = near(both, [threshold], "g", kind="rank").select("g.g", "a", "b", F.round(1 - F.col("distances")[0] / longer, 9).alias("ratio"))
    found = cut(found, "commitment-pairs")
    best = lambda one, other: found.groupBy("g", one).agg(F.min_by(F.struct(other, "ratio"), F.struct(-F.col("ratio"), f"{other}.item")).alias("m")).select("g", one, F.col(f"m.{other}").alias(other), "m.ratio")
    links = best("b", "a").join(best("a", "b").drop("ratio"), ["g", "a", "b"])
    node = lambda c: F.struct(F.col(f"{c}.rank").alias("rank"), F.col(f"{c}.item").alias("item"))
    links = cut(links.select("g", node("b").alias("node"), node("a").alias("to"), "ratio"), "commitment-links")
    began = links.join(heads(links), ["g", "node"])
    later = links.select("g", F.col("to").alias("node"), F.lit(True).alias("goes_on"))
    out = known.withColumn("node", F.struct("rank", "item")).join(began, ["g", "node"], "left").join(later, ["g", "node"], "left")
    out = out.withColumn("head", F.coalesce("head", "node"))
    first = periods.select("g", F.col("period").alias("chain_period"), F.col("rank").alias("head_rank"))
    out = out.withColumn("head_rank", F.col("head.rank")).join(first, ["g", "head_rank"])
    status = F.when(F.col("rank") == 1, "first").when(F.col("to").isNull(), "new").when(F.col("ratio") == 1, "kept").otherwise("changed")
    return out.select(
        F.col("g").alias(by), F.col("period").alias(period), F.col("item").alias(item), status.alias("status"), F.col("to.item").alias("previous_item"), "ratio",
        (F.col("goes_on").isNull() & (F.col("rank") < F.col("last"))).alias("dropped"), "chain_period", F.col("head.item").alias("chain_item"),
    )
