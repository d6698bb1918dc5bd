"""Points in intervals by a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, by: str = "doc_id", pos: str = "pos", start: str = "s", end: str = "e", width: int = 100_000) -> DataFrame:
    """Each point (by, pos) with the columns of the interval [start, end) of its ``by`` that it lies in;
    points in none drop. The intervals of one ``by`` don't overlap; empty ones hold nothing.

    Starts and points of a stretch of ``width`` positions stand in one ordered window, which carries the
    last start to the points after it. An interval is there once for each stretch that it reaches into, so
    that a long document is many windows, and no point meets more than one interval.
    """
    more = [c for c in intervals.columns if c not in (by, start, end)]
    there = intervals.where(F.col(start) < F.col(end)).select(F.col(by).alias("g"), F.col(start).cast("long").alias("from"), F.struct(F.col(end).cast("long").alias("to"), *more).alias("open"))
    there = there.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("open.to") - 1) / width))))
    starts = there.select("g", "bin", F.greatest("from", F.col("bin") * width).alias("at"), F.lit(0).alias("kind"), "open", F.lit(None).cast(points.schema).alias("point"))
    at = F.col(pos).cast("long")
    found = points.select(F.col(by).alias("g"), F.floor(at / width).alias("bin"), at.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(there.schema["open"].dataType).alias("open"), F.struct(*points.columns).cast(points.schema).alias("point"))
    order = Window.partitionBy("g", "bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.union(found).withColumn("last", F.last("open", ignorenulls=True).over(order))
    return swept.where("kind = 1 and at < last.to").select("point.*", *[F.col(f"last.{c}").alias(c) for c in more])
