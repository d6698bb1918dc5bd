"""The work queue of a language model: prompt tables out, response tables in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain_filter

# Labels and separators of replies.
LIST_SPLIT = r'[,\n•\-\[\]"]+'
ITEM_SPLIT = r'[•\-\[\]"]+'
LISTS = ["keywords", "speakers", "action_items", "key_quotes"]
FIELDS = ["keywords", "speakers", "importance", "action_items", "key_quotes"]
ANNOTATION = "struct<summary:string,keywords:array<string>,speakers:array<string>,importance:int,action_items:array<string>,key_quotes:array<string>>"
#: Instructions by the place of a chunk.
PLACES = {"beginning": "Introduce the subject and the people.", "middle": "Keep decisions and facts.", "end": "Keep conclusions and next steps."}
SPOKEN = "This is a transcript: keep who says what."
#: Instructions of a synthesis by level of detail, and whether the text is spoken.
SYNTHESIS = {
    "essential": "Combine these sections in a paragraph.", "essential spoken": "Combine these sections in a paragraph that names the speakers.",
    "detailed": "Combine these sections, with all decisions and figures.", "detailed spoken": "Combine these sections, with all decisions and who took them.",
    "detailed-complex": "Combine these sections theme by theme, with open questions.", "detailed-complex spoken": "Combine these sections theme by theme, with each speaker's view and open questions.",
}
TYPES = {"transcript": "Name who says what.", "earnings": "Keep figures and guidance.", "academic": "Keep method and findings.", "general": "Keep the main points."}


def queued(rows: DataFrame, prompt: Column, *keep: str) -> DataFrame:
    """A prompt table: key columns, the prompt, and the hash of the whole prompt."""
    return rows.select(*keep, prompt.alias("prompt")).withColumn("prompt_key", F.md5("prompt"))


def lookup(key: Column, table: dict[str, str], default: str = "") -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(known, key), F.lit(default))


def joined_text(rows: DataFrame, key: str, text: str, order: str, sep: str = "\n") -> DataFrame:
    """The texts of a key in order, as one column ``body``."""
    return rows.groupBy(key).agg(F.expr(f"listagg({text}, '{sep}') within group (order by {order})").alias("body"))


def pending(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Distinct prompts without a cached response, by the hash of the whole text."""
    return prompts.dropDuplicates(["prompt_key"]).join(responses.select("prompt_key"), "prompt_key", "left_anti")


def attached(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Every chunk with its response; a missing one gives the fallback annotation: importance 1
    and empty lists."""
    found = chunks.join(responses, ["doc_id", "chunk_index"], "left")
    none = F.col("response").isNull()
    empty = {c: F.when(none, F.array().cast("array<string>")) for c in LISTS}
    return found.withColumns({"failed": none, "importance": F.when(none, 1)} | empty)


def labelled(text: Column, name: str, stops: list[str]) -> Column:
    """What follows a label up to the next one, lower case; empty without the label."""
    upto = "|".join([*(f"{s}:" for s in stops), r"\z"])
    return F.regexp_extract(F.lower(text), f"(?s){name}:(.+?)(?:{upto})", 1)


def split_list(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def json_of(reply: Column) -> Column:
    """The JSON object of a reply as a variant: the whole reply, else what a code fence holds, else what
    stands between the first and the last brace; null where none of them is an object."""
    parts = (reply, F.regexp_extract(reply, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1), F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    found = [F.try_parse_json(x) for x in parts]
    return F.coalesce(*[F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v) for v in found])


def text_in(found: Column, name: str) -> Column:
    """A field of a variant as text: strings as they are, other values as JSON."""
    return F.try_variant_get(found, f"$.{name}", "string")


def list_in(found: Column, name: str, pattern: str) -> Column:
    """A list field of a variant: an array's values as they are, without nulls; a single text split as in the
    labelled form; empty where it is missing or null."""
    values = F.filter(F.try_variant_get(found, f"$.{name}", "array<string>"), lambda x: x.isNotNull())
    return F.coalesce(values, split_list(text_in(found, name), pattern), F.array().cast("array<string>"))


def level_in(found: Column, name: str) -> Column:
    """A level: a number, rounded half up, or the first number in a text; else 3."""
    first = F.nullif(F.regexp_extract(text_in(found, name), r"(\d+)", 1), F.lit(""))
    return F.coalesce(F.round(F.try_variant_get(found, f"$.{name}", "double")).cast("int"), first.cast("int"), F.lit(3))


def _labelled_level(response: Column) -> Column:
    level = F.regexp_extract(F.lower(response), r"importance:\s*(\d)", 1)
    return F.when(level == "", 3).otherwise(level.cast("int"))


def _labelled_summary(response: Column) -> Column:
    said = F.regexp_replace(F.split(response, "keywords:")[0], r"^\s+|\s+$", "")
    return F.when(F.contains(F.lower(response), F.lit("keywords:")), said).otherwise(response)


def parsed_annotation(response: Column, schema: str = ANNOTATION) -> Column:
    """An annotation from a reply: its JSON object, whatever the types of its fields, else its labelled
    fields. A null reply gives null."""
    found = json_of(response)
    read = lambda name, stops, pattern: split_list(labelled(response, name, stops), pattern)
    text = F.struct(
        _labelled_summary(response).alias("summary"), read("keywords", FIELDS[1:], LIST_SPLIT).alias("keywords"), read("speakers", FIELDS[2:], LIST_SPLIT).alias("speakers"),
        _labelled_level(response).alias("importance"), read("action_items", FIELDS[4:], ITEM_SPLIT).alias("action_items"), read("key_quotes", [], ITEM_SPLIT).alias("key_quotes"),
    )
    given = F.struct(
        text_in(found, "summary").alias("summary"), list_in(found, "keywords", LIST_SPLIT).alias("keywords"), list_in(found, "speakers", LIST_SPLIT).alias("speakers"), level_in(found, "importance").alias("importance"),
        list_in(found, "action_items", ITEM_SPLIT).alias("action_items"), list_in(found, "key_quotes", ITEM_SPLIT).alias("key_quotes"),
    )
    return F.when(response.isNull(), None).when(found.isNotNull(), given.cast(schema)).otherwise(text.cast(schema))


SECTION = "struct<summary:string,keywords:array<string>,speakers:array<string>,importance:int,next_steps:string>"


def parsed_section(response: Column) -> Column:
    """The older form of five fields, with ``next_steps``, a text or a list, as one text."""
    found = json_of(response)
    read = lambda name, stops, pattern: split_list(labelled(response, name, stops), pattern)
    steps = lambda x: F.array_join(x, "; ")
    text = F.struct(
        _labelled_summary(response).alias("summary"), read("keywords", FIELDS[1:], LIST_SPLIT).alias("keywords"), read("speakers", FIELDS[2:], LIST_SPLIT).alias("speakers"),
        _labelled_level(response).alias("importance"), steps(read("next_steps", ["key_quotes"], ITEM_SPLIT)).alias("next_steps"),
    )
    given = F.struct(
        text_in(found, "summary").alias("summary"), list_in(found, "keywords", LIST_SPLIT).alias("keywords"), list_in(found, "speakers", LIST_SPLIT).alias("speakers"),
        level_in(found, "importance").alias("importance"), steps(list_in(found, "next_steps", ITEM_SPLIT)).alias("next_steps"),
    )
    return F.when(response.isNull(), None).when(found.isNotNull(), given.cast(SECTION)).otherwise(text.cast(SECTION))


# Items of a list in a labelled preview, fields of a preview, words for no value.
PREVIEW_ITEM = r"[-•*]?\s*([^,\n]+)"
PREVIEW = "struct<summary:string,client_name:string,meeting_purpose:string,key_topics:array<string>,domain_categories:array<string>,participants:array<string>>"
NO_VALUE = ["null", "none", "n/a"]


def parsed_preview(response: Column) -> Column:
    """The six fields of a preview: from the reply's JSON object as it says, else from its labelled lines in lower case, where null, none
    and n/a are no value and categories are those that hold a known domain.

    Labelled lists run from their label to the next list's, so over several lines; only a mark right after the label or a comma
    goes. Missing texts are null but for the summary, which is then empty; missing lists are empty. A null reply gives null.
    """
    found, low = json_of(response), F.lower(response)
    line = lambda name: F.trim(F.regexp_extract(low, f"{name}:([^\n]*)", 1))
    value = lambda name: F.when(~line(name).isin("", *NO_VALUE), line(name))

    def listed(name: str, upto: str | None = None) -> Column:
        rest = F.coalesce(F.get(F.split(low, f"{name}:"), F.lit(1)), F.lit(""))
        part = F.get(F.split(rest, f"{upto}:"), F.lit(0)) if upto else rest
        return F.filter(F.transform(F.regexp_extract_all(part, F.lit(PREVIEW_ITEM), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")

    text = F.struct(
        line("summary").alias("summary"), value("client_name").alias("client_name"), value("meeting_purpose").alias("meeting_purpose"), listed("key_topics", "domain_categories").alias("key_topics"),
        domain_filter(listed("domain_categories", "participants")).alias("domain_categories"), listed("participants").alias("participants"),
    )
    given = F.struct(
        F.coalesce(text_in(found, "summary"), F.lit("")).alias("summary"), text_in(found, "client_name").alias("client_name"), text_in(found, "meeting_purpose").alias("meeting_purpose"),
        *[list_in(found, c, LIST_SPLIT).alias(c) for c in ("key_topics", "domain_categories", "participants")],
    )
    return F.when(response.isNull(), None).when(found.isNotNull(), given.cast(PREVIEW)).otherwise(text.cast(PREVIEW))


def pass_prompt() -> Column:
    """The prompt of a pass for a chunk, over columns of both: purpose, kind of document, client, position, instructions,
    categories and fields with their descriptions, form of the answer, whole text. Parts that are null or empty are left out."""
    told = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["description"])), "\n"))
    after = lambda label, body: F.concat(F.lit(label), F.nullif(body, F.lit("")))
    kind = F.when(F.col("is_transcript"), "Document type: meeting transcript").otherwise("Document type: document")
    form = F.concat(F.lit('Answer as JSON: {"'), "item_key", F.lit('": [items]}'))
    return F.concat_ws(
        "\n", "purpose", kind, after("Client: ", F.col("client")), after("Section position: ", F.col("position")), after("Instructions: ", F.col("instructions")),
        after("Use these categories:\n", told("categories")), after("Give for each item:\n", told("fields")), form, F.lit("Text:"), "text",
    )


def parsed_items(response: Column, item_key: str, schema: str) -> Column:
    """Items of the array under ``item_key``; none where the reply isn't such JSON."""
    return F.from_json(F.get_json_object(response, f"$.{item_key}"), f"array<{schema}>")


def bullets(text: Column) -> Column:
    """Items of lines after a dash, a star or a number, kind by kind."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"- ([^\n]+)", r"\* ([^\n]+)", r"\d+\.\s+([^\n]+)")]))
    return F.transform(found, lambda x: F.trim(x))


#: Marks of the sections of a combined reply, the second where a reply has none of the first.
MARKS = ["## SUMMARY FOR SECTION ", "SECTION "]


def batched_parts(reply: Column) -> Column:
    """Parts of a combined reply, after each numbered marker."""

    def cut_at(marker: str) -> Column:
        return F.transform(F.filter(F.split(reply, f"(?={marker}\\d+)"), lambda x: F.regexp_like(x, F.lit(f"^{marker}\\d"))), lambda x: F.trim(F.regexp_replace(x, f"^{marker}\\d+", "")))

    return F.when(F.regexp_like(reply, F.lit(MARKS[0] + r"\d")), cut_at(MARKS[0])).otherwise(cut_at(MARKS[1]))


def split_batched(asked: DataFrame) -> DataFrame:
    """Parts of combined replies ``body`` to ``n`` sections; where a reply is missing or has
    another number of parts, one row without a part that says to queue the document anew."""
    found = asked.withColumn("parts", batched_parts(F.coalesce("body", F.lit(""))))
    whole = F.size("parts") == F.col("n")
    parts = found.where(whole).select("doc_id", F.posexplode("parts").alias("part", "summary"), F.lit(False).alias("requeue"))
    return parts.unionByName(found.where(~whole).select("doc_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("summary"), F.lit(True).alias("requeue")))
