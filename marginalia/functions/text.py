"""Text statistics and classification as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that define the results.
WORD = r"[\p{L}\p{N}_]+"
#: White space as SQL's patterns have it, and all else; Java's own classes differ in the vertical tab.
SPACE, INK = r"[\t\n\f\r ]", r"[^\t\n\f\r ]"
SENTENCE_INNER, SENTENCE_LAST = r"[.!?]+\s+[A-Z]", r"[.!?]+\n?\z"
SPEAKERS = [r"([A-Z][a-z]+ [A-Z][a-z]+):", r"([A-Z][a-z]+):", r"(Dr\. [A-Z][a-z]+):", r"(Mr\. [A-Z][a-z]+):", r"(Mrs\. [A-Z][a-z]+):", r"(Ms\. [A-Z][a-z]+):"]
STRUCTURE = [r"\n#{1,3}\s+", r"\n[A-Z][A-Z\s]+[A-Z]:", r"\n[A-Z][A-Z\s]+\n"]
EARNINGS = r"(?i)(quarterly|earnings|revenue|fiscal|dividend|EPS)"
ACADEMIC = r"(?i)(abstract|introduction|methodology|conclusion)"
LIKELY = [r"\d{1,2}:\d{2}(:\d{2})?\s*[AP]M", r"(?m)^[A-Z][a-z]+:", r"(?m)^[A-Z][a-z]+ [A-Z][a-z]+:", r"meeting (started|began|commenced)", r"call (started|began|commenced)", r"(attendees|participants|present):"]
LIKELY_WORDS = ["meeting", "call", "discussion", "conversation", "transcript"]
TURNS = [r"^\s*[A-Z][a-z]+:", r"^\s*[A-Z][a-z]+ [A-Z][a-z]+:", r"\n\s*[A-Z][a-z]+:", r"\n\s*[A-Z][a-z]+ [A-Z][a-z]+:"]
STAMPS = [r"\d{1,2}:\d{2}(:\d{2})?\s*[AP]M", r"\[\d{1,2}:\d{2}(:\d{2})?\]"]
TEAMS = [r"\d{1,2}:\d{2}:\d{2}\s+[AP]M\s+From\s+.+:", r"Meeting\s+started:", r"Meeting\s+ended:", r"[\p{L}\p{N}_\s]+\s+\(\d{1,2}:\d{2}:\d{2}\s+[AP]M\)"]
TEAMS_SPEAKER = r"\d{1,2}:\d{2}:\d{2}\s+[AP]M\s+From\s+([^:]+):"
DOMAINS = [
    "AI", "Data", "Data Management", "AI Governance", "Platforms", "AI Adoption", "People", "Skills", "Strategy", "Technology", "Innovation", "Cloud", "Analytics", "Machine Learning",
    "Digital Transformation", "Security", "Infrastructure", "DevOps", "Agile", "Product Management", "Customer Experience", "Finance", "Marketing", "Sales", "HR", "Legal", "Operations",
    "Supply Chain", "Risk Management", "Compliance", "Enterprise Architecture",
]
INDICATORS = ["quarter", "earnings", "revenue", "guidance", "dividend", "fiscal year", "EPS"]
COMPANY_HEADERS = [r"([A-Z][A-Za-z\s]+)(?:,? Inc\.|,? Corp\.|,? Corporation|,? Ltd\.)\s+(?:Q\d|Quarter)", r"([A-Z][A-Za-z\s]+)(?:,? Inc\.|,? Corp\.|,? Corporation|,? Ltd\.)\s+Earnings\s+Call"]
COMPANY = r"([A-Z][A-Za-z\s]+)(?:,? Inc\.|,? Corp\.|,? Ltd\.)"
PERIOD = r"(Q\d\s+\d{4}|Quarter\s+\d\s+\d{4})"
DATES = [r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\s*,\s*\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}-\d{2}-\d{2}"]


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def matches(text: Column, pattern: str) -> Column:
    """Number of matches."""
    return F.size(all_matches(text, pattern))


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.regexp_like(text, F.lit(p)) for p in patterns))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def basic_stats(text: Column) -> dict[str, Column]:
    words = all_matches(text, WORD)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return {
        "char_count": F.length(text),
        "char_count_no_spaces": F.length(F.translate(text, " \n\t", "")),
        "word_count": F.size(words),
        "sentence_count": matches(text, SENTENCE_INNER) + matches(text, SENTENCE_LAST),
        "paragraph_count": F.size(F.filter(F.split(text, "\n\n"), lambda p: F.regexp_like(p, F.lit(r"\S")))),
        "estimated_tokens": F.floor(F.length(text) / 4).cast("int"),
        "avg_word_length": F.when(F.size(words) > 0, F.bround(total / F.size(words), 1)).otherwise(F.lit(0.0)),
    }


def assessment(text: Column) -> dict[str, Column]:
    """Type, traits and recommended division of a document, by its first 2000 characters."""
    sample, tokens = F.substring(text, 1, 2000), F.length(text) / 4
    speakers, structure = any_match(sample, SPEAKERS), any_match(sample, STRUCTURE)
    return {
        "estimated_tokens": tokens,
        "has_speakers": speakers,
        "has_structure": structure,
        "doc_type": F.when(speakers, "transcript").when(F.regexp_like(sample, F.lit(EARNINGS)), "earnings").when(F.regexp_like(sample, F.lit(ACADEMIC)), "academic").otherwise("general"),
        "recommended_strategy": F.when(speakers, "long").when(structure, "complex").when(tokens > 50000, "long").otherwise("essential"),
        "recommended_divisions": F.when(tokens < 25000, 1).when(tokens < 50000, 2).when(tokens < 75000, 3).otherwise(F.greatest(F.lit(3), F.floor(tokens / 25000).cast("int"))),
    }


def likely_transcript(text: Column, participants: Column, purpose: Column, summary: Column) -> Column:
    by_text = any_match(F.substring(text, 1, 2000), LIKELY)
    by_people = (F.size(participants) > 1) & (F.coalesce(purpose, F.lit("")) != "")
    said = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(summary, F.lit(""))), F.lit(w)) for w in LIKELY_WORDS))
    return by_text | F.coalesce(by_people, F.lit(False)) | said


def transcript_like(text: Column) -> Column:
    sample = F.substring(text, 1, 3000)
    turns = reduce(lambda a, b: a + b, (matches(sample, p) for p in TURNS))
    return (turns >= 5) | (reduce(lambda a, b: a + b, (matches(sample, p) for p in STAMPS)) >= 3)


def speakers(text: Column) -> Column:
    """Sorted distinct names before a colon."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[all_matches(text, p, 1) for p in SPEAKERS]))))


def teams_speakers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_matches(text, TEAMS_SPEAKER, 1), lambda x: F.trim(x))))


def occurrences(text: Column, part: Column) -> Column:
    """How often a non-empty string occurs, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def domain_filter(categories: Column) -> Column:
    known = F.array(*[F.lit(d.lower()) for d in DOMAINS])
    return F.filter(categories, lambda c: F.exists(known, lambda d: F.contains(F.lower(c), d)))


def content_dates(text: Column) -> Column:
    sample = F.substring(text, 1, 1000)
    return F.flatten(F.array(*[all_matches(sample, p) for p in DATES]))


def parsed_date(date: Column) -> Column:
    return F.coalesce(*[F.try_to_date(date, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy")])


def first_line(text: Column) -> Column:
    return F.split(text, "\n")[0]
