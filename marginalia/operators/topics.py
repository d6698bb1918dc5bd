"""Topics and term statistics over annotations (doc_id, chunk_index, keywords, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.lists import COLLECTION_STOP, ENGLISH_STOP, EXTRA_STOP, SECTION_STOP
from .annotate import chunk_terms, most_frequent


def exploded_keywords(notes: DataFrame) -> DataFrame:
    return notes.select("doc_id", "chunk_index", "position", "importance", F.posexplode("keywords").alias("at", "keyword"))


def top_topics(notes: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent keywords a document; equal counts by first appearance."""
    g = exploded_keywords(notes).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct("chunk_index", "at")).alias("first"))
    rank = F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "first"))
    return g.select("doc_id", "keyword", "frequency", rank.alias("rank")).where(F.col("rank") <= k)


def topic_relevance(notes: DataFrame, k: int = 10) -> DataFrame:
    """Frequency times mean importance times factors for position and spread; case folded."""
    sections = notes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    g = exploded_keywords(notes).groupBy("doc_id", F.lower("keyword").alias("keyword")).agg(
        F.count(F.lit(1)).alias("frequency"), F.sum("importance").alias("total"), F.count_distinct("chunk_index").alias("spread"),
        F.bool_or(F.col("position") == "beginning").alias("b"), F.bool_or(F.col("position") == "end").alias("e"),
    )
    place = F.when(F.col("b") & F.col("e"), 1.5).when(F.col("b"), 1.2).when(F.col("e"), 1.1).otherwise(1.0)
    spread = F.least(1.0 + F.col("spread") / F.col("sections") * 0.5, F.lit(1.5))
    g = g.join(sections, "doc_id").withColumn("relevance", F.round(F.col("frequency") * (F.col("total") / F.col("frequency")) * place * spread, 9))
    rank = F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("relevance"), "keyword"))
    return g.select("doc_id", "keyword", "frequency", "relevance", rank.alias("rank")).where(F.col("rank") <= k)


def distinct_items(notes: DataFrame, column: str, clean: bool = False) -> DataFrame:
    """Distinct entries of a list column over a document's chunks, by first appearance. With
    ``clean`` one leading mark goes, and entries under 5 characters."""
    rows = notes.select("doc_id", "chunk_index", F.posexplode(column).alias("at", "item"))
    if clean:
        rows = rows.where(F.length("item") >= 5).withColumn("item", F.trim(F.regexp_replace(F.trim("item"), "^[-*]", "")))
    first = rows.where("item <> ''").groupBy("doc_id", "item").agg(F.min(F.struct("chunk_index", "at")).alias("first"))
    return first.select("doc_id", "item", F.row_number().over(W.Window.partitionBy("doc_id").orderBy("first")).alias("place"))


def merged_keywords(parts: list[DataFrame]) -> DataFrame:
    """Keyword weights of several sources, the largest a keyword."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "keyword").agg(F.max("weight").alias("weight"))


def top_terms(docs: DataFrame, k: int, stop: list[str], key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k most frequent terms a key; equal counts by term. A key's texts are counted in one row, so that a task holds
    the words of one key at a time, not those of all its keys."""
    texts = docs.groupBy(*key).agg(F.collect_list("text").alias("texts"))  # a document's
    top = most_frequent(F.transform("texts", F.lower), k, stop)
    rows = texts.select(*key, F.posexplode_outer(top).alias("at", "t")).where("t is not null")
    return rows.select(*key, "t.term", "t.tf", (F.col("at") + 1).alias("rank"))


def wordcloud_terms(docs: DataFrame) -> DataFrame:
    return top_terms(docs, 100, sorted({*ENGLISH_STOP, *EXTRA_STOP}))


def section_topics(chunks: DataFrame) -> DataFrame:
    return top_terms(chunks, 5, SECTION_STOP, ("doc_id", "chunk_index"))


def topic_flow(chunks: DataFrame) -> DataFrame:
    """Shares of the topics of the next section that follow a topic."""
    t = section_topics(chunks)
    a = t.select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("term").alias("from_topic"))
    pairs = a.join(t.select("doc_id", "chunk_index", F.col("term").alias("to_topic")), ["doc_id", "chunk_index"])
    g = pairs.groupBy("doc_id", "from_topic", "to_topic").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("prob", F.col("n") / F.sum("n").over(W.Window.partitionBy("doc_id", "from_topic")))


def term_matrix(texts: DataFrame, k: int = 10) -> DataFrame:
    """(label, term, share) of the k most frequent terms overall, per label of ``texts``."""
    counts = chunk_terms(texts, ("label",), COLLECTION_STOP)
    top = counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(k).select("term")
    labels = texts.select("label").distinct()
    full = labels.crossJoin(F.broadcast(top)).join(counts, ["label", "term"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))  # k terms
    total = F.sum("tf").over(W.Window.partitionBy("label"))
    return full.select("label", "term", F.when(total > 0, F.col("tf") / total).alias("share"))


def frequency_weight(count: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.floor(count / 2).cast("int") + 1))
