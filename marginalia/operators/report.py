"""Reports as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def section(title: str, body: Column) -> Column:
    """A headed section; null, and so left out by concat_ws, without a body."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body))


def document(title: Column, *parts: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *parts)


def bullet_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def information(text: Column, blank: int = 0) -> Column:
    """Size of a text as lines: characters, words and, where it has any, speakers. A null text counts as empty; ``blank``: the
    words of a text of white space alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.when(F.regexp_like(text, F.lit(r"\S")), F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))).otherwise(blank)
    who = X.bound(F.size(X.speakers(text)), lambda n: F.when(n > 0, F.concat(F.lit("- Speakers: "), F.format_number(n, 0))))
    return F.concat_ws("\n", F.concat(F.lit("- Characters: "), F.format_number(F.length(text), 0)), F.concat(F.lit("- Words: "), F.format_number(words, 0)), who)


#: Kinds of collections as a report names them.
KINDS = {"earnings_calls_multi_company": "Comparison of companies", "earnings_calls_sequential": "Development of a company"}
TOGETHER = "Documents together"


def collection_report(rows: DataFrame) -> DataFrame:
    """(collection_id, report) over documents (collection_id, doc_id, collection_type, company, label, place, text, actions): how
    they were taken, whom or what they cover by the type of the collection, all action items, each whole text under its label.

    Documents come by place, then id. Null labels are the ids, null texts and lists of actions empty; a collection without
    actions has no section of them. Types not known are taken together.
    """
    label = F.coalesce("label", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    rows = rows.withColumns({"label": label, "acts": F.nullif(bullet_list(F.col("actions")), F.lit("")), "block": F.concat(F.lit("### "), label, F.lit("\n"), F.coalesce("text", F.lit("")))})
    listed = lambda c, sep: F.expr(f"listagg({c}, '{sep}') within group (order by place, doc_id)").alias(c)
    g = rows.groupBy("collection_id").agg(
        F.min("collection_type").alias("kind"), F.min("company").alias("company"), F.count(F.lit(1)).alias("n"),
        listed("label", ", "), listed("acts", "\\n"), listed("block", "\\n\\n---\\n\\n"),
    )
    kind, named = F.col("kind"), F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    covers = F.when(kind == "earnings_calls_multi_company", "Companies: ").when(kind == "earnings_calls_sequential", "Periods: ").otherwise("Titles: ")
    known = F.concat_ws(
        "\n", F.concat(F.lit("Analysis: "), F.coalesce(F.element_at(named, kind), F.lit(TOGETHER))), F.when(kind == "earnings_calls_sequential", F.concat(F.lit("Company: "), "company")),
        F.concat(covers, "label"), F.concat(F.lit("Documents: "), F.col("n").cast("string")),
    )
    title = F.concat(F.lit("Collection "), F.coalesce(F.col("collection_id").cast("string"), F.lit("-")))
    return g.select("collection_id", document(title, section("Analysis information", known), section("Action items", F.col("acts")), section("Documents", F.col("block"))).alias("report"))


#: Levels with a block of their own in reports by priority, compared without case.
LEVELS = ["High", "Medium", "Low"]


def pass_report(items: DataFrame, title: str, form: Column, summaries: DataFrame) -> DataFrame:
    """(doc_id, report) of an extraction pass over items (doc_id, item_id, title, description, category, severity, maybe speaker).

    On top stands the document's text of ``summaries`` (doc_id, summary), if it has one, then the number of items a category, then
    the items in whole, by ``form``: in blocks by ``priority``, with those of another or no level last, in blocks by
    ``category``, or ``flat``. Items come in order of their ids. Null titles, descriptions and categories have a standing text, a null or
    empty speaker no line. A block's items are joined before a document's blocks; documents without items have no report.
    """
    flat, author = F.col("form") == "flat", F.col("speaker") if "speaker" in items.columns else F.lit(None).cast("string")
    category = F.coalesce("category", F.lit("Uncategorized"))
    level = F.array_position(F.array(*[F.lit(x.lower()) for x in LEVELS]), F.lower(F.coalesce("severity", F.lit(""))))
    named = F.when(level > 0, F.concat(F.get(F.array(*map(F.lit, LEVELS)), (level - 1).cast("int")), F.lit(" priority items"))).otherwise("Items of other priority")
    rows = items.withColumn("form", form).select(
        "doc_id", "item_id", category.alias("category"),
        F.when(F.col("form") == "priority", F.when(level > 0, level).otherwise(len(LEVELS) + 1)).otherwise(0).alias("k"),
        F.when(F.col("form") == "priority", named).when(~flat, category).alias("block"),
        F.concat_ws(
            "\n\n", F.concat(F.when(flat, "### ").otherwise("#### "), F.coalesce("title", F.lit("Untitled item"))), F.when(flat | (F.col("form") == "priority"), F.concat(F.lit("**Category**: "), category)),
            F.concat(F.lit("**Raised by**: "), F.nullif(author, F.lit(""))), F.coalesce("description", F.lit("No description provided.")), F.lit("---"),
        ).alias("line"),
    )
    listed = lambda c, sep, order: F.expr(f"listagg({c}, '{sep}') within group (order by {order})")
    blocks = rows.groupBy("doc_id", "k", "block").agg(listed("line", "\\n\\n", "item_id").alias("lines"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("### "), F.col("block"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    body = blocks.withColumn("text", F.concat_ws("\n\n", head, "lines")).groupBy("doc_id").agg(listed("text", "\\n\\n", "k, block").alias("body"), F.sum("n").alias("total"))
    counts = rows.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.concat(F.lit("- **"), "category", F.lit("**: "), F.col("n").cast("string"), F.lit(" items")))
    counts = counts.groupBy("doc_id").agg(listed("c", "\\n", "category").alias("counts"))
    found = body.join(counts, "doc_id").join(summaries.select("doc_id", "summary"), "doc_id", "left")
    items_head = F.concat(F.lit("## Identified items ("), F.col("total").cast("string"), F.lit(")"))
    return found.select("doc_id", document(F.lit(title), section("Summary", F.col("summary")), section("Categories", F.col("counts")), items_head, F.col("body")).alias("report"))
