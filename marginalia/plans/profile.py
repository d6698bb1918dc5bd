"""Document statistics and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as X
from ..registry import literal as q
from ..registry import query
from ..views import load

_words = f"regexp_extract_all(text, {q(X.WORD)})"
_any = lambda s, ps: "(" + " OR ".join(f"regexp_matches({s}, {q(p)})" for p in ps) + ")"
_count = lambda s, p: f"len(regexp_extract_all({s}, {q(p)}))"
_speakers = lambda s: "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({s}, {q(p)}, 1)" for p in X.SPEAKERS) + "])))"


@query("basic_stats", f"""SELECT doc_id, length(text) AS char_count, length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), '')) AS char_count_no_spaces,
 len({_words}) AS word_count, {_count("text", X.SENTENCE_INNER)} + {_count("text", X.SENTENCE_LAST)} AS sentence_count,
 len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) AS paragraph_count, length(text) // 4 AS estimated_tokens,
 CASE WHEN len({_words}) > 0 THEN round_even(list_sum(list_transform({_words}, lambda w: length(w))) / len({_words}), 1) ELSE 0 END AS avg_word_length FROM documents""")
def basic_stats(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in X.basic_stats(F.col("text")).items()])


_assess = f"""WITH s AS (SELECT doc_id, length(text) / 4 AS estimated_tokens, substr(text, 1, 2000) AS sample FROM {{v}}),
 t AS (SELECT *, {_any("sample", X.SPEAKERS)} AS has_speakers, {_any("sample", X.STRUCTURE)} AS has_structure FROM s)
 SELECT doc_id, estimated_tokens, has_speakers, has_structure,
 CASE WHEN has_speakers THEN 'transcript' WHEN regexp_matches(sample, {q(X.EARNINGS)}) THEN 'earnings' WHEN regexp_matches(sample, {q(X.ACADEMIC)}) THEN 'academic' ELSE 'general' END AS doc_type,
 CASE WHEN has_speakers THEN 'long' WHEN has_structure THEN 'complex' WHEN estimated_tokens > 50000 THEN 'long' ELSE 'essential' END AS recommended_strategy,
 CASE WHEN estimated_tokens < 25000 THEN 1 WHEN estimated_tokens < 50000 THEN 2 WHEN estimated_tokens < 75000 THEN 3 ELSE greatest(3, CAST(floor(estimated_tokens / 25000) AS INTEGER)) END AS recommended_divisions FROM t"""


@query("assess_document", _assess.replace("{v}", "dossiers"), "dossiers")
def assess_document(spark, sf_dir):
    return load(spark, sf_dir, "dossiers").select("doc_id", *[c.alias(k) for k, c in X.assessment(F.col("text")).items()])


@query("likely_transcript", f"""SELECT doc_id, {_any("substr(text, 1, 2000)", X.LIKELY)} OR (doc_id % 3 = 0 AND doc_id % 2 = 0)
 OR {" OR ".join(f"contains(lower(substr(text, 1, 50)), {q(w)})" for w in X.LIKELY_WORDS)} AS is_meeting_transcript FROM documents""")
def likely_transcript(spark, sf_dir):
    people = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    purpose = F.when(F.col("doc_id") % 2 == 0, "review")
    found = X.likely_transcript(F.col("text"), people, purpose, F.substring("text", 1, 50))
    return load(spark, sf_dir, "documents").select("doc_id", found.alias("is_meeting_transcript"))


_like = "(" + " + ".join(_count("substr(text, 1, 3000)", p) for p in X.TURNS) + " >= 5 OR " + " + ".join(_count("substr(text, 1, 3000)", p) for p in X.STAMPS) + " >= 3)"


@query("transcript_like", f"SELECT doc_id, {_like} AS is_transcript FROM transcripts", "transcripts")
def transcript_like(spark, sf_dir):
    return load(spark, sf_dir, "transcripts").select("doc_id", X.transcript_like(F.col("text")).alias("is_transcript"))


@query("teams_transcript", f"SELECT doc_id, {_any('substr(text, 1, 5000)', X.TEAMS)} AS is_teams FROM teams_transcripts UNION ALL SELECT doc_id, {_any('substr(text, 1, 5000)', X.TEAMS)} FROM transcripts", "teams_transcripts transcripts")
def teams_transcript(spark, sf_dir):
    both = load(spark, sf_dir, "teams_transcripts").select("doc_id", "text").union(load(spark, sf_dir, "transcripts").select("doc_id", "text"))
    return both.select("doc_id", X.any_match(F.substring("text", 1, 5000), X.TEAMS).alias("is_teams"))


@query("extract_speakers", f"SELECT doc_id, {_speakers('text')} AS speakers FROM transcripts", "transcripts")
def extract_speakers(spark, sf_dir):
    return load(spark, sf_dir, "transcripts").select("doc_id", X.speakers(F.col("text")).alias("speakers"))


@query("teams_speakers", f"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, {q(X.TEAMS_SPEAKER)}, 1), lambda x: trim(x)))) AS speakers FROM teams_transcripts", "teams_transcripts")
def teams_speakers(spark, sf_dir):
    return load(spark, sf_dir, "teams_transcripts").select("doc_id", X.teams_speakers(F.col("text")).alias("speakers"))


@query("speaker_distribution", f"""WITH s AS (SELECT doc_id, text, unnest({_speakers('text')}) AS speaker FROM transcripts),
 c AS (SELECT doc_id, speaker, (length(text) - length(replace(text, speaker || ':', ''))) // (length(speaker) + 1) AS n FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, speaker) AS k FROM c WHERE n > 0)
 SELECT doc_id, speaker, n, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM r WHERE k <= 10""", "transcripts")
def speaker_distribution(spark, sf_dir):
    rows = load(spark, sf_dir, "transcripts").select("doc_id", "text", F.explode(X.speakers(F.col("text"))).alias("speaker"))
    rows = rows.select("doc_id", "speaker", X.occurrences(F.col("text"), F.concat("speaker", F.lit(":"))).alias("n")).where("n > 0")
    doc = W.Window.partitionBy("doc_id")
    top = rows.withColumn("k", F.row_number().over(doc.orderBy(F.desc("n"), "speaker"))).where("k <= 10")
    return top.select("doc_id", "speaker", "n", (F.col("n") / F.sum("n").over(doc)).alias("share"))


@query("preview", "SELECT doc_id, substr(text, 1, 2000) AS preview, length(substr(text, 1, 2000)) AS preview_length FROM documents")
def preview(spark, sf_dir):
    p = F.substring("text", 1, 2000)
    return load(spark, sf_dir, "documents").select("doc_id", p.alias("preview"), F.length(p).alias("preview_length"))


_domains = "[" + ", ".join(q(d.lower()) for d in X.DOMAINS) + "]"


@query("domain_filter", f"SELECT item_id, list_filter([category, category || ' office', title, 'cloud of ' || title], lambda c: len(list_filter({_domains}, lambda d: contains(lower(c), d))) > 0) AS domains FROM items", "items")
def domain_filter(spark, sf_dir):
    given = F.array("category", F.concat("category", F.lit(" office")), "title", F.concat(F.lit("cloud of "), "title"))
    return load(spark, sf_dir, "items").select("item_id", X.domain_filter(given).alias("domains"))


_score = " + ".join(f"CAST(contains(lower(substr(text, 1, 5000)), {q(w)}) AS INTEGER)" for w in X.INDICATORS)


@query("collection_type", f"""WITH d AS (SELECT collection_id, company, {_score} AS score, flatten([{", ".join(f"regexp_extract_all(substr(text, 1, 1000), {q(p)}, 1)" for p in X.COMPANY_HEADERS)}]) AS found FROM calls),
 g AS (SELECT collection_id, count(*) AS n, sum(score) AS score, count(DISTINCT company) AS named FROM d GROUP BY 1),
 f AS (SELECT collection_id, count(DISTINCT c) AS headed FROM (SELECT collection_id, unnest(found) AS c FROM d) GROUP BY 1)
 SELECT collection_id, n AS documents, CAST(score AS BIGINT) AS score, CASE WHEN named > 0 THEN named ELSE coalesce(headed, 0) END AS companies,
 CASE WHEN score > 2 * n AND (CASE WHEN named > 0 THEN named ELSE coalesce(headed, 0) END) > 1 THEN 'earnings_calls_multi_company' WHEN score > 2 * n AND n > 1 THEN 'earnings_calls_sequential' ELSE 'generic_documents' END AS collection_type
 FROM g LEFT JOIN f USING (collection_id)""", "calls")
def collection_type(spark, sf_dir):
    score, headers = _signs()
    g = load(spark, sf_dir, "calls").groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(score).alias("score"), F.count_distinct("company").alias("named"), F.collect_set(headers).alias("headers")
    )
    companies, kind = _kind(F.col("documents"), F.col("score"), F.col("named"), F.col("headers"))
    return g.select("collection_id", "documents", "score", companies.alias("companies"), kind.alias("collection_type"))


def _signs():
    """How many words of earnings calls a text has, and the companies in its headers."""
    text = F.col("text")
    low = F.lower(F.substring(text, 1, 5000))
    score = sum((F.contains(low, F.lit(w)).cast("int") for w in X.INDICATORS[1:]), F.contains(low, F.lit(X.INDICATORS[0])).cast("int"))
    headers = F.flatten(F.array(*[X.all_matches(F.substring(text, 1, 1000), p, 1) for p in X.COMPANY_HEADERS]))
    return score, headers


def _kind(documents, score, named, headers):
    """Number of companies of a collection, and its type."""
    companies = F.when(named > 0, named).otherwise(F.size(F.array_distinct(F.flatten(headers))).cast("long"))
    strong = score > 2 * documents
    return companies, F.when(strong & (companies > 1), "earnings_calls_multi_company").when(strong & (documents > 1), "earnings_calls_sequential").otherwise("generic_documents")


def labelled_calls(spark, sf_dir):
    """Documents of collections with collection_type, company, label and place ``k``. Windows over the collection find them
    beside the text, so that texts are shuffled once."""
    whole = W.Window.partitionBy("collection_id")
    rows = load(spark, sf_dir, "calls")
    score, headers = _signs()
    rows = rows.withColumns({"score": score, "headers": headers, "day": X.parsed_date(F.col("date"))})
    rows = rows.withColumns({
        "documents": F.count(F.lit(1)).over(whole), "score": F.sum("score").over(whole), "named": F.size(F.collect_set("company").over(whole)).cast("long"), "headers": F.collect_set("headers").over(whole),
        "place": F.row_number().over(whole.orderBy("doc_id")), "in_time": F.row_number().over(whole.orderBy(F.asc_nulls_last("day"), "doc_id")),
    })
    kind = _kind(F.col("documents"), F.col("score"), F.col("named"), F.col("headers"))[1]
    rows = rows.select("collection_id", "doc_id", "text", kind.alias("collection_type"), _company().alias("company"), _period(_cut_period()).alias("period"), _title().alias("title"), "place", "in_time")
    kind = F.col("collection_type")
    label = F.when(kind == "earnings_calls_multi_company", F.col("company")).when(kind == "earnings_calls_sequential", F.col("period")).otherwise(F.col("title"))
    return rows.select("collection_id", "doc_id", "text", "collection_type", "company", label.alias("label"), F.when(kind == "earnings_calls_sequential", F.col("in_time")).otherwise(F.col("doc_id")).alias("k"))


_place = "row_number() OVER (PARTITION BY collection_id ORDER BY doc_id)"


def _ranked(spark, sf_dir):
    return load(spark, sf_dir, "calls").withColumn("place", F.row_number().over(W.Window.partitionBy("collection_id").orderBy("doc_id")))


@query("company_name", f"SELECT doc_id, coalesce(company, nullif(trim(regexp_extract(string_split(text, chr(10))[1], {q(X.COMPANY)}, 1)), ''), 'Company ' || {_place}) AS company FROM calls", "calls")
def company_name(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", _company().alias("company"))


def _company():
    found = F.trim(X.first_match(X.first_line(F.col("text")), X.COMPANY))
    return F.coalesce("company", found, F.concat(F.lit("Company "), F.col("place").cast("string")))


@query("period_label", f"SELECT doc_id, coalesce(nullif(regexp_extract(substr(text, 1, 500), {q(X.PERIOD)}, 1), ''), date, 'Period ' || {_place}) AS period FROM (SELECT doc_id, collection_id, date, CASE WHEN doc_id % 3 = 0 THEN substr(text, 30) ELSE text END AS text FROM calls)", "calls")
def period_label(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", _period(_cut_period()).alias("period"))


def _cut_period():
    """The text, of every third document without its head line's period."""
    return F.when(F.col("doc_id") % 3 == 0, F.expr("substr(text, 30)")).otherwise(F.col("text"))


def _period(text):
    return F.coalesce(X.first_match(F.substring(text, 1, 500), X.PERIOD), "date", F.concat(F.lit("Period "), F.col("place").cast("string")))


@query("chronological", """WITH p AS (SELECT collection_id, doc_id, coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y'), try_strptime(date, '%B %d, %Y'))::DATE AS day FROM calls)
 SELECT collection_id, doc_id, day, row_number() OVER (PARTITION BY collection_id ORDER BY day NULLS LAST, doc_id) AS place FROM p""", "calls")
def chronological(spark, sf_dir):
    rows = load(spark, sf_dir, "calls").select("collection_id", "doc_id", X.parsed_date(F.col("date")).alias("day"))
    return rows.withColumn("place", F.row_number().over(W.Window.partitionBy("collection_id").orderBy(F.asc_nulls_last("day"), "doc_id")))


@query("title_label", f"SELECT doc_id, coalesce(title, CASE WHEN length(line) < 100 THEN line ELSE 'Document ' || place END) AS title FROM (SELECT doc_id, title, trim(trim(string_split(text, chr(10))[1], '#')) AS line, {_place} AS place FROM calls)", "calls")
def title_label(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", _title().alias("title"))


def _title():
    line = F.trim(F.trim(X.first_line(F.col("text")), F.lit("#")))
    return F.coalesce("title", F.when(F.length(line) < 100, line), F.concat(F.lit("Document "), F.col("place").cast("string")))


@query("content_dates", f"SELECT doc_id, flatten([{', '.join(f'regexp_extract_all(substr(t, 1, 1000), {q(p)})' for p in X.DATES)}]) AS dates FROM (SELECT doc_id, date || ' ' || text AS t FROM calls)", "calls")
def content_dates(spark, sf_dir):
    return load(spark, sf_dir, "calls").select("doc_id", X.content_dates(F.concat_ws(" ", "date", "text")).alias("dates"))


@query("file_profile", f"""SELECT doc_id, source || '_notes.txt' AS file_name, upper(substr(source, 1, 1)) || lower(substr(source, 2)) || ' Notes' AS title, length(text) AS chars,
 len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS words, {_speakers('text')} AS speakers, len({_speakers('text')}) AS speaker_count FROM documents""")
def file_profile(spark, sf_dir):
    from ..sources.files import file_profile as profile

    return profile(load(spark, sf_dir, "documents").withColumn("file_name", F.concat("source", F.lit("_notes.txt")))).select("doc_id", "file_name", "title", "chars", "words", "speakers", "speaker_count")
