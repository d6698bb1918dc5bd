"""All queries of the notes engine by name, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.breaks import sized
from .operators import annotate as A
from .operators import divide as D
from .operators import report as R
from .plans import division, exchange, items, notes, profile  # noqa: F401
from .registry import QUERIES, SQL, oracle, query  # noqa: F401
from .views import load


@query("notes_flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts to reports: statistics, chunks, keywords, top topics, one report a row."""
    docs = load(spark, sf_dir, "transcripts").select("doc_id", "text")
    stats = docs.select("doc_id", *[X.basic_stats(F.col("text"))[k].alias(k) for k in ("char_count", "word_count")], X.transcript_like(F.col("text")).alias("is_transcript"))
    chunks = D.exploded(docs, sized(F.col("text"), lambda t, n: D.even(t, n, 3, D.default_size(n, 3))))
    words = A.chunk_keywords(chunks, 5)
    topics = words.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("topics"))  # five a chunk
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    full = stats.join(counts, "doc_id", "left").join(topics, "doc_id", "left")
    report = R.document(F.concat(F.lit("Notes "), F.col("doc_id").cast("string")), R.section("Topics", R.bullet_list(F.col("topics"))), R.section("Processing", F.format_string("%d chunks, %d words", "chunks", "word_count")))
    return full.select("doc_id", "char_count", "word_count", "is_transcript", "chunks", "topics", report.alias("report"))
