"""Action items, issues and maturity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import ArrayType

from ..functions.lists import LEVELS


def as_items(found: Column) -> Column:
    """Items of a text: its bullet lines, or else the whole of it."""
    lines = F.transform(F.filter(F.split(found, "\n"), lambda x: F.regexp_like(F.trim(x), F.lit(r"^[-*]"))), lambda x: F.trim(x))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.trim(found)))


def candidates(notes: DataFrame) -> DataFrame:
    """Action items of all chunks, given as lists or as texts, one mark stripped, with what is known of their chunk."""
    items = F.col("action_items") if isinstance(notes.schema["action_items"].dataType, ArrayType) else as_items(F.col("action_items"))
    rows = notes.select("doc_id", F.col("chunk_index").alias("source_chunk"), F.coalesce("position", F.lit("unknown")).alias("position"), F.coalesce("importance", F.lit(3)).alias("importance"), "speakers", F.posexplode(items).alias("place", "item"))
    return rows.select("doc_id", "source_chunk", "place", F.trim(F.regexp_replace(F.trim("item"), r"^[-*]", "")).alias("text"), "position", "importance", "speakers")


def validated(items: DataFrame, scores: DataFrame, least: int = 3) -> DataFrame:
    """Candidates with a score of ``least`` or more, matched by index; unknown indexes drop."""
    return items.join(scores.where(F.col("score") >= least).select("doc_id", "idx", F.col("score").alias("validation_score"), "reason"), ["doc_id", "idx"])


def prioritised(items: DataFrame, group: str = "group_id") -> DataFrame:
    """The best item of each group of similar ones, with assignee and due date of the first
    that has them, ranked in its document."""
    w = W.Window.partitionBy("doc_id", group).orderBy(F.desc("score"), F.desc("importance"), F.desc(F.col("assignee").isNotNull()), F.desc(F.col("due").isNotNull()), "idx")
    every = w.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    rows = items.withColumns({"k": F.row_number().over(w), "who": F.first("assignee", ignorenulls=True).over(every), "when_": F.first("due", ignorenulls=True).over(every)})
    best = rows.where("k = 1")
    rank = F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("importance"), "idx"))
    return best.select("doc_id", "idx", "text", F.col("who").alias("assignee"), F.col("when_").alias("due"), "score", "importance", rank.alias("rank"))


def formatted(text: Column, assignee: Column, due: Column) -> Column:
    """Text with its assignee before and its due date after, unless it names them."""
    absent = lambda x, t: x.isNotNull() & ~F.contains(F.lower(t), F.lower(x))
    named = F.when(absent(assignee, text), F.concat(assignee, F.lit(": "), text)).otherwise(text)
    return F.when(absent(due, named), F.concat(named, F.lit(" (Due: "), due, F.lit(")"))).otherwise(named)


def priority(label: Column, order: dict[str, int]) -> Column:
    """Number of a label, 0 for an unknown or null one."""
    known = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.coalesce(F.element_at(known, label), F.lit(0))


def severity_group(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low == "high", "High").when(low == "medium", "Medium").when(low == "low", "Low").otherwise("Other")


def maturity(assessments: DataFrame) -> DataFrame:
    """Most frequent level a dimension (ties: the lower), with first evidence and the
    document's overall level, the floor of the mean."""
    g = assessments.groupBy("doc_id", "dimension", "level").agg(F.count(F.lit(1)).alias("n"), F.min_by("evidence", "item_id").alias("evidence"))
    k = F.row_number().over(W.Window.partitionBy("doc_id", "dimension").orderBy(F.desc("n"), "level"))
    best = g.withColumn("k", k).where("k = 1")
    name = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level").cast("int"))
    overall = F.floor(F.avg("level").over(W.Window.partitionBy("doc_id")))
    return best.select("doc_id", "dimension", "level", name.alias("level_name"), "n", "evidence", overall.alias("overall"))
