"""Offline annotation of chunks: terms, keywords, summaries, importance, actions, speakers."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.lists import COMMIT_TERMS, SECTION_STOP
from ..functions.text import SPACE, WORD, all_matches
from ..sources.scratch import cut

BULLET = r"^\s*(?:[-*•]|\d+\.)\s+"


#: The same words of a lower-case text in one match each, for the tasks that count them.
TERM = re.compile(r"(?<!\w)[a-z]{3,}+(?!\w)")


def terms(text: Column, stop: list[str]) -> Column:
    """Lower-case words of three or more ASCII letters, without stopwords."""
    words = F.filter(all_matches(F.lower(text), WORD), lambda w: F.regexp_like(w, F.lit("^[a-z]{3,}$")))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def sentence_weights(lowered: Column, stop: list[str]) -> Column:
    """For each of a chunk's sentences, in lower case, the sum of its terms' counts in the chunk and the number of
    its terms. A task holds the words of one chunk at a time."""
    known, kind = frozenset(stop), pa.list_(pa.struct([("total", pa.int64()), ("n", pa.int64())]))

    def weighed(said: list[str] | None) -> list[dict] | None:
        if said is None:
            return None
        words = [[w for w in TERM.findall(s) if w not in known] for s in said]
        tf = Counter(w for ws in words for w in ws)
        return [{"total": sum(tf[w] for w in ws), "n": len(ws)} for ws in words]

    def run(rows: pa.Array) -> pa.Array:
        return pa.array((weighed(x.as_py()) for x in rows), kind)

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<total:bigint,n:bigint>>")(lowered)


def most_frequent(lowered: Column, k: int, stop: list[str]) -> Column:
    """The k most frequent terms of a list of texts in lower case, with their counts; equal counts by term."""
    known, kind = frozenset(stop), pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def counted(texts: pa.Scalar) -> list[dict]:
        tf = Counter(w for t in texts.values or () if t.is_valid for w in TERM.findall(t.as_py()) if w not in known)
        return [{"term": w, "tf": n} for w, n in sorted(tf.items(), key=lambda x: (-x[1], x[0]))[:k]]

    def run(rows: pa.Array) -> pa.Array:
        return pa.array((counted(x) for x in rows), kind)

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<term:string,tf:bigint>>")(lowered)


def chunk_terms(chunks: DataFrame, key: tuple[str, ...] = ("doc_id", "chunk_index"), stop: list[str] = SECTION_STOP) -> DataFrame:
    """Term counts a chunk."""
    return chunks.select(*key, F.explode(terms(F.col("text"), stop)).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def chunk_keywords(chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k terms of a chunk of the highest tf-idf; equal scores by term."""
    counts = chunk_terms(chunks)
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = chunks.agg(F.count(F.lit(1)).alias("n"))  # one row
    scored = counts.join(frequency, "term").crossJoin(F.broadcast(total)).withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 9))
    rank = F.row_number().over(W.Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("score"), "term"))
    return scored.select("doc_id", "chunk_index", "term", "tf", "score", rank.alias("rank")).where(F.col("rank") <= k)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, rf"[.!?]+{SPACE}+"), lambda s: s != "")


def extractive_summary(chunks: DataFrame, k: int = 3) -> DataFrame:
    """The k sentences whose terms are the most frequent in the chunk on average, in order. Each row is a chunk and
    summed up by itself, without a shuffle; chunks without a term give no row."""
    rows = chunks.select("doc_id", "chunk_index", sentences(F.col("text")).alias("said"))
    rows = rows.withColumn("weights", sentence_weights(F.transform("said", F.lower), SECTION_STOP))
    score = lambda w, i: F.struct(F.when(w["n"] > 0, -F.round(w["total"] / w["n"], 9)).alias("score"), i.alias("i"))
    best = F.slice(F.sort_array(F.filter(F.transform("weights", score), lambda x: x["score"].isNotNull())), 1, k)
    rows = rows.withColumn("best", F.sort_array(F.transform(best, lambda x: x["i"]))).where(F.size("best") > 0)
    return rows.select("doc_id", "chunk_index", F.array_join(F.transform("best", lambda i: F.get("said", i)), ". ").alias("summary"))


def importance(chunks: DataFrame) -> DataFrame:
    """1 to 5: fifths of a document's chunks by the number of their terms."""
    rows = chunks.withColumn("score", F.size(terms(F.col("text"), SECTION_STOP)))
    return rows.select("doc_id", "chunk_index", "score", F.ntile(5).over(W.Window.partitionBy("doc_id").orderBy("score", "chunk_index")).alias("importance"))


def actions(text: Column, terms_: list[str] = COMMIT_TERMS) -> Column:
    """Bullet lines without their marks, else sentences with a word of commitment between white space, their start or their
    very end. Patterns and lower case are those of SQL, where a dotted capital I becomes a plain i."""
    mark = BULLET.replace(r"\s", SPACE)
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(mark))), lambda x: F.regexp_replace(x, mark, ""))
    word = rf"(^|{SPACE})({'|'.join(terms_)})({SPACE}|\z)"
    said = F.filter(sentences(text), lambda s: F.regexp_like(F.lower(F.replace(s, F.lit("\u0130"), F.lit("i"))), F.lit(word)))
    return F.when(F.size(lines) > 0, lines).otherwise(said)


def quotes(text: Column) -> Column:
    return all_matches(text, r'"([^"]+)"', 1)


def merged_levels(rows: DataFrame, size: int = 3, levels: int = 2) -> DataFrame:
    """Groups of ``size`` consecutive items merged to one, level by level: the text of a group
    is its items' in order."""
    found, now = None, rows.select("doc_id", F.col("chunk_index").alias("item"), "text")
    for level in range(1, levels + 1):
        group = F.floor(F.col("item") / size).cast("long").alias("item")
        now = now.groupBy("doc_id", group).agg(F.expr("listagg(text, ' | ') within group (order by item)").alias("text"), F.count(F.lit(1)).alias("items"))
        tagged = now.select("doc_id", F.lit(level).alias("level"), "item", "items", "text")
        found = tagged if found is None else found.union(tagged)
    return found


def merge_tree(rows: DataFrame, budget: int, sep: str = " | ") -> DataFrame:
    """Every node (doc_id, level, node, first, last, size, text) of the trees that merge the items (doc_id, item, text)
    of a document, from the items at level 0 up to one node.

    At each level the sizes before an item, summed up in order, tell its group: items go together while
    they begin below one more ``budget``; at least two go together, so that a level halves. A node's text is that
    of its items in order, so nothing is lost. A level is written before the next; only whether a document
    has several nodes left comes to the driver. Null texts are empty.
    """
    order = W.Window.partitionBy("doc_id").orderBy("node")
    now = rows.select("doc_id", F.lit(0).cast("long").alias("level"), F.row_number().over(W.Window.partitionBy("doc_id").orderBy("item")).cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    now = now.withColumns({"node": F.col("node") - 1, "size": F.length("text").cast("long")}).withColumns({"first": F.col("node"), "last": F.col("node")})
    found = []
    while True:
        found.append(cut(now.select("doc_id", "level", "node", "first", "last", "size", "text"), "merge-level"))
        now = found[-1].withColumns({"many": F.count(F.lit(1)).over(W.Window.partitionBy("doc_id")), "before": F.sum("size").over(order) - F.col("size")}).where("many > 1")
        if not now.head(1):
            break
        group = F.least(F.floor(F.col("before") / budget), F.floor(F.col("node") / 2))
        now = now.groupBy("doc_id", group.alias("part")).agg((F.max("level") + 1).alias("level"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"), F.expr(f"listagg(text, '{sep}') within group (order by node)").alias("text"))
        now = now.withColumn("node", F.row_number().over(W.Window.partitionBy("doc_id").orderBy("part")).cast("long") - 1)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def key_sections(chunks: DataFrame, whole: int = 0) -> DataFrame:
    """(doc_id, chunk_index, text) of the first, the last and, of more than three, the middle chunk of a document; a document
    of under ``whole`` characters gives one row instead, its whole text, chunks joined by a line feed, as chunk 0. Null texts are empty."""
    doc = W.Window.partitionBy("doc_id")
    rows = chunks.select("doc_id", "chunk_index", F.coalesce("text", F.lit("")).alias("text")).withColumns({"n": F.count(F.lit(1)).over(doc), "size": F.sum(F.length("text") + 1).over(doc) - 1})
    i = F.col("chunk_index")
    key = (i == 0) | (i == F.col("n") - 1) | ((F.col("n") > 3) & (i == F.floor(F.col("n") / 2)))
    rows = rows.where((F.col("size") < whole) | key)
    at = F.when(F.col("size") < whole, 0).otherwise(i).alias("chunk_index")
    return rows.groupBy("doc_id", at).agg(F.expr("listagg(text, '\n') within group (order by chunk_index)").alias("text"))
