"""Several ways to divide each document, side by side, from one reading of its text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.breaks import Known, blocks, cut_out, sized, with_starts
from .annotate import sentences
from .report import document, information

#: A strategy: pieces (s, e, kind) of a text of a given length, and with known starts of patterns.
Strategy = Callable[..., Column]
NONE = "No summary available."


def results(text: Column, strategies: dict[str, Strategy], known: Known | None = None) -> Column:
    """An array of (strategy, divisions, summary) in the order given: the summary is the first whole sentence of each
    division. A strategy without divisions, or a null text, has 0 divisions and no summary. Strategies get the starts in ``known``, if there are any,
    as a third argument."""

    def lead(parts: Column, piece: Column) -> Column:
        return F.get(sentences(F.trim(cut_out(parts, piece["s"], piece["e"]))), F.lit(0))

    def told(name: str, make: Strategy, parts: Column) -> Column:
        row = lambda p: F.struct(
            F.lit(name).alias("strategy"), F.coalesce(F.size(p), F.lit(0)).cast("long").alias("divisions"),
            F.coalesce(F.array_join(F.filter(F.transform(p, lambda x: lead(parts, x)), lambda x: x.isNotNull()), ". "), F.lit("")).alias("summary"),
        )
        return X.bound(F.when(text.isNotNull(), sized(text, lambda t, n: make(t, n, known) if known else make(t, n))), row)

    return X.bound(blocks(text), lambda parts: F.array(*[told(name, make, parts) for name, make in strategies.items()]))


def metrics(docs: DataFrame, strategies: dict[str, Strategy], common: Sequence[str] = ()) -> DataFrame:
    """(doc_id, strategy, total, divisions, summary_length, division_share, length_share): each strategy of a document over
    the largest of its document, and, with ``total`` and no doc_id, each over all documents: sums, and means of the shares.

    The starts of ``common`` patterns are looked for once and handed to all strategies. The shares of a document come from its own row; the only shuffle is that of the two groupings. Where the largest is 0 the shares
    are 0. Rows repeated under one doc_id are one document of their sums. No documents give no rows.
    """
    docs, known = with_starts(docs, list(common))
    rows = docs.select("doc_id", F.transform(results(F.col("text"), strategies, known), lambda r: F.struct(r["strategy"].alias("strategy"), r["divisions"].alias("divisions"), F.length(r["summary"]).cast("long").alias("length"))).alias("r"))
    largest = lambda c: F.array_max(F.col(f"r.{c}")).alias(f"most_{c}")
    rows = rows.select("doc_id", largest("divisions"), largest("length"), F.inline_outer("r"))  # plain inline would have the results filtered by their size, and so made twice
    share = lambda c: F.when(F.col(f"most_{c}") > 0, F.col(c) / F.col(f"most_{c}")).otherwise(0.0)
    rows = rows.withColumns({"ds": share("divisions"), "ls": share("length")})
    g = rows.groupingSets([[F.col("doc_id"), F.col("strategy")], [F.col("strategy")]], "doc_id", "strategy")
    total = F.grouping("doc_id") == 1
    g = g.agg(total.alias("total"), F.sum("divisions").alias("divisions"), F.sum("length").alias("summary_length"), F.round(F.avg("ds"), 9).alias("division_share"), F.round(F.avg("ls"), 9).alias("length_share"))
    return g.select("doc_id", "strategy", "total", "divisions", "summary_length", "division_share", "length_share")


def comparison_report(docs: DataFrame, strategies: dict[str, Strategy], common: Sequence[str] = ()) -> DataFrame:
    """(doc_id, report): size and speakers of a document, a table of its strategies, the summary of each. Every report is made
    in its own row, without a shuffle. A null text counts as empty; times of models have no place here."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, known = with_starts(rows, list(common))
    rows = rows.select("doc_id", "text", results(F.col("text"), strategies, known).alias("r"))
    comma = lambda x: F.format_number(x, 0)
    line = lambda r: F.concat(F.lit("| "), r["strategy"], F.lit(" | "), comma(r["divisions"]), F.lit(" | "), comma(F.length(r["summary"])), F.lit(" chars |"))
    table = F.concat(F.lit("| Strategy | Divisions | Summary length |\n|---|---|---|\n"), F.array_join(F.transform("r", line), "\n"))
    part = lambda r: F.concat(F.lit("### "), F.initcap(r["strategy"]), F.lit(" strategy\n"), F.when(r["summary"] == "", NONE).otherwise(r["summary"]))
    parts = F.array_join(F.transform("r", part), "\n\n---\n\n")
    head = lambda t, body: F.concat(F.lit(f"## {t}\n"), body)
    title = F.concat(F.lit("Comparison "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return rows.select("doc_id", document(title, head("Document information", information(F.col("text"))), head("Strategy comparison", table), head("Strategy summaries", parts)).alias("report"))
