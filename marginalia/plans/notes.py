"""Annotation, topic and term queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import lists as L
from ..functions import text as X
from ..operators import annotate as A
from ..operators import divide as D
from ..operators import strategies as ST
from ..operators import topics as T
from ..registry import BODY
from ..registry import literal as q
from ..registry import query
from ..views import load
from . import folds
from .division import TOKENS, _essential, _essential_sql


def _chunks(spark, sf_dir):
    return load(spark, sf_dir, "sections").withColumnRenamed("summary", "text")


def _list(words):
    return "[" + ", ".join(map(q, words)) + "]"


def _terms(text, stop):
    return f"list_filter(regexp_extract_all(lower({text}), {q(X.WORD)}), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_list(stop)}, w))"


_ct = f"t AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest({_terms('summary', L.SECTION_STOP)}) AS term FROM annotations) GROUP BY ALL)"


@query("chunk_terms", f"WITH {_ct} SELECT * FROM t", "annotations")
def chunk_terms(spark, sf_dir):
    return A.chunk_terms(_chunks(spark, sf_dir))


@query("stopword_anti", f"SELECT doc_id, term FROM (SELECT doc_id, unnest({_terms('summary', [])}) AS term FROM annotations) WHERE term NOT IN ({', '.join(map(q, L.COLLECTION_STOP))})", "annotations")
def stopword_anti(spark, sf_dir):
    words = _chunks(spark, sf_dir).select("doc_id", F.explode(A.terms(F.col("text"), [])).alias("term"))
    stop = spark.createDataFrame([(w,) for w in L.COLLECTION_STOP], "term string")
    return words.join(F.broadcast(stop), "term", "left_anti").select("doc_id", "term")  # 19 words


@query("chunk_keywords", f"""WITH {_ct}, d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM annotations),
 s AS (SELECT doc_id, chunk_index, term, tf, round(tf * ln(n / df), 9) AS score FROM t JOIN d USING (term), n)
 SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY score DESC, term) AS "rank" FROM s QUALIFY "rank" <= 10""", "annotations")
def chunk_keywords(spark, sf_dir):
    return A.chunk_keywords(_chunks(spark, sf_dir))


@query("extractive_summary", f"""WITH r AS (SELECT doc_id, chunk_index, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, chunk_index, list_filter(string_split_regex(summary, '[.!?]+\\s+'), lambda x: x <> '') AS s FROM annotations)),
 w AS (SELECT doc_id, chunk_index, i, unnest({_terms('sentence', L.SECTION_STOP)}) AS term FROM r), f AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM w GROUP BY ALL),
 s AS (SELECT doc_id, chunk_index, i, round(avg(tf), 9) AS score FROM w JOIN f USING (doc_id, chunk_index, term) GROUP BY ALL),
 k AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY score DESC, i) AS n FROM r JOIN s USING (doc_id, chunk_index, i))
 SELECT doc_id, chunk_index, string_agg(sentence, '. ' ORDER BY i) AS summary FROM k WHERE n <= 3 GROUP BY ALL""", "annotations")
def extractive_summary(spark, sf_dir):
    return A.extractive_summary(_chunks(spark, sf_dir))


@query("chunk_importance", f"SELECT doc_id, chunk_index, score, ntile(5) OVER (PARTITION BY doc_id ORDER BY score, chunk_index) AS importance FROM (SELECT doc_id, chunk_index, len({_terms('summary', L.SECTION_STOP)}) AS score FROM annotations)", "annotations")
def chunk_importance(spark, sf_dir):
    return A.importance(_chunks(spark, sf_dir))


_said = r"(^|\s)(" + "|".join(L.COMMIT_TERMS) + r")(\s|$)"


def _acts(text):
    """A text's actions: its bullet lines, else its sentences with a word of commitment."""
    lines = f"list_transform(list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, {q(A.BULLET)})), lambda x: regexp_replace(x, {q(A.BULLET)}, ''))"
    said = f"list_filter(list_filter(string_split_regex({text}, '[.!?]+\\s+'), lambda x: x <> ''), lambda x: regexp_matches(lower(x), {q(_said)}))"
    return f"CASE WHEN len({lines}) > 0 THEN {lines} ELSE {said} END"


@query("chunk_actions", f"""SELECT doc_id, CASE WHEN len(b) > 0 THEN list_transform(b, lambda x: regexp_replace(x, {q(A.BULLET)}, '')) ELSE s END AS actions FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {q(A.BULLET)})) AS b,
 list_filter(list_filter(string_split_regex(text, '[.!?]+\\s+'), lambda x: x <> ''), lambda x: regexp_matches(lower(x), {q(_said)})) AS s FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM dossiers))""", "dossiers")
def chunk_actions(spark, sf_dir):
    both = load(spark, sf_dir, "documents").select("doc_id", "text").union(load(spark, sf_dir, "dossiers").select(-1 - F.col("doc_id"), "text"))
    return both.select("doc_id", A.actions(F.col("text")).alias("actions"))


@query("chunk_quotes", "SELECT doc_id, chunk_index, regexp_extract_all(response, '\"([^\"]+)\"', 1) AS key_quotes FROM responses", "responses")
def chunk_quotes(spark, sf_dir):
    return load(spark, sf_dir, "responses").select("doc_id", "chunk_index", A.quotes(F.col("response")).alias("key_quotes"))


@query("chunk_speakers", "SELECT conv_id AS doc_id, turn AS chunk_index, list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, {q(p)}, 1)" for p in X.SPEAKERS) + "]))) AS speakers FROM conversations")
def chunk_speakers(spark, sf_dir):
    said = F.concat(F.initcap("role"), F.lit(": "), "text")
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), X.speakers(said).alias("speakers"))


@query("hierarchical_merge", """WITH a AS (SELECT doc_id, chunk_index // 3 AS item, string_agg(summary, ' | ' ORDER BY chunk_index) AS text, count(*) AS items FROM annotations GROUP BY ALL),
 b AS (SELECT doc_id, a.item // 3 AS item, string_agg(text, ' | ' ORDER BY a.item) AS text, count(*) AS items FROM a GROUP BY ALL)
 SELECT doc_id, 1 AS level, item, items, text FROM a UNION ALL SELECT doc_id, 2, item, items, text FROM b""", "annotations")
def hierarchical_merge(spark, sf_dir):
    return A.merged_levels(_chunks(spark, sf_dir))


LONG = 60_000  # characters from which on a text is summarised in tiers
BUDGET = 2_000  # characters of a merged node, as far as a level allows
_tree = """WITH RECURSIVE t AS (SELECT doc_id, 0::BIGINT AS level, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS node, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS first, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS last, length(text) AS size, text FROM ({src})
  UNION ALL SELECT doc_id, level + 1, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1, first, last, size, text FROM (
   SELECT doc_id, part, max(level) AS level, min(first) AS first, max(last) AS last, CAST(sum(size) AS BIGINT) AS size, string_agg(text, ' | ' ORDER BY node) AS text FROM (
    SELECT *, least((before // {budget})::BIGINT, node // 2) AS part FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY node) - size AS BIGINT) AS before, count(*) OVER (PARTITION BY doc_id) AS many FROM t) WHERE many > 1) GROUP BY doc_id, part))"""


@query("merge_tree", _tree.format(src="SELECT doc_id, chunk_index, summary AS text FROM annotations", budget=1000) + " SELECT * FROM t", "annotations")
def merge_tree(spark, sf_dir):
    rows = load(spark, sf_dir, "annotations").select("doc_id", F.col("chunk_index").alias("item"), F.col("summary").alias("text"))
    return A.merge_tree(rows, 1000)


_long = f"SELECT doc_id, chunk_index, text AS summary FROM ({_essential_sql('binders', 1)}) WHERE doc_id IN (SELECT doc_id FROM binders WHERE length(text) >= {LONG})"
_sums = BODY["extractive_summary"].replace("FROM annotations", f"FROM ({_long})")


@query("tiered_summary", _tree.format(src=f"SELECT doc_id, chunk_index, summary AS text FROM ({_sums})", budget=BUDGET) + " SELECT doc_id, level AS levels, text AS summary FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1", "binders")
def tiered_summary(spark, sf_dir):
    """Long texts: sections, a summary of each by its sentences, merged level by level to one."""
    from ..functions.breaks import sized

    big = load(spark, sf_dir, "binders").where(F.length("text") >= LONG)
    parts = A.extractive_summary(D.exploded(big, sized(F.col("text"), lambda t, n: D.essential(t, n, 1, TOKENS))))
    tree = A.merge_tree(parts.select("doc_id", F.col("chunk_index").alias("item"), F.col("summary").alias("text")), BUDGET)
    top = F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("level")))
    return tree.withColumn("top", top).where("top = 1").select("doc_id", F.col("level").alias("levels"), F.col("text").alias("summary"))


WHOLE = 2000  # characters below which a text is its own sample


@query("key_section_sample", f"""WITH s AS (SELECT doc_id, chunk_index, summary, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(summary) + 1) OVER (PARTITION BY doc_id) - 1 AS size FROM annotations)
 SELECT doc_id, chunk_index, summary AS text FROM s WHERE size >= {WHOLE} AND (chunk_index = 0 OR chunk_index = n - 1 OR (n > 3 AND chunk_index = n // 2))
 UNION ALL SELECT doc_id, 0, string_agg(summary, chr(10) ORDER BY chunk_index) FROM s WHERE size < {WHOLE} GROUP BY doc_id""", "annotations")
def key_section_sample(spark, sf_dir):
    return A.key_sections(_chunks(spark, sf_dir), WHOLE)


_k = "k AS (SELECT doc_id, chunk_index, position, importance, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS ix FROM annotations)"


@query("top_topics", f"""WITH {_k}, g AS (SELECT doc_id, keyword, count(*) AS frequency, min((chunk_index, ix)) AS f FROM k GROUP BY ALL)
 SELECT doc_id, keyword, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, f) AS "rank" FROM g QUALIFY "rank" <= 15""", "annotations")
def top_topics(spark, sf_dir):
    return T.top_topics(load(spark, sf_dir, "annotations"))


@query("topic_relevance", f"""WITH {_k}, n AS (SELECT doc_id, count(*) AS sections FROM annotations GROUP BY 1),
 g AS (SELECT doc_id, lower(keyword) AS kw, count(*) AS frequency, sum(importance) AS total, count(DISTINCT chunk_index) AS spread, bool_or(position = 'beginning') AS b, bool_or(position = 'end') AS e FROM k GROUP BY ALL),
 r AS (SELECT doc_id, kw AS keyword, frequency, round(frequency * (total / frequency) * CASE WHEN b AND e THEN 1.5::DOUBLE WHEN b THEN 1.2::DOUBLE WHEN e THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * least(1.0::DOUBLE + spread / sections * 0.5::DOUBLE, 1.5::DOUBLE), 9) AS relevance FROM g JOIN n USING (doc_id))
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, keyword) AS "rank" FROM r QUALIFY "rank" <= 10""", "annotations")
def topic_relevance(spark, sf_dir):
    return T.topic_relevance(load(spark, sf_dir, "annotations"))


@query("all_speakers", "SELECT doc_id, list_sort(list_distinct(flatten(list(speakers)))) AS speakers FROM annotations GROUP BY doc_id", "annotations")
def all_speakers(spark, sf_dir):
    said = load(spark, sf_dir, "annotations").select("doc_id", F.explode_outer("speakers").alias("s"))
    return said.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("speakers"))


_distinct = "WITH r AS (SELECT doc_id, chunk_index, unnest(action_items) AS item, generate_subscripts(action_items, 1) AS ix FROM annotations), g AS (SELECT doc_id, {} AS item, min((chunk_index, ix)) AS f FROM r WHERE {} GROUP BY ALL) SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS place FROM g WHERE item <> ''"


@query("unique_actions", _distinct.format("item", "true"), "annotations")
def unique_actions(spark, sf_dir):
    return T.distinct_items(load(spark, sf_dir, "annotations"), "action_items")


@query("cleaned_actions", _distinct.format("trim(regexp_replace(trim(item), '^[-*]', ''))", "length(item) >= 5"), "annotations")
def cleaned_actions(spark, sf_dir):
    return T.distinct_items(load(spark, sf_dir, "annotations"), "action_items", clean=True)


@query("not_already_seen", "WITH r AS (SELECT doc_id, unnest(action_items) AS item FROM annotations WHERE chunk_index > 0) SELECT DISTINCT doc_id, item FROM r WHERE (doc_id, item) NOT IN (SELECT doc_id, unnest(action_items) FROM annotations WHERE chunk_index = 0)", "annotations")
def not_already_seen(spark, sf_dir):
    rows = load(spark, sf_dir, "annotations").select("doc_id", "chunk_index", F.explode("action_items").alias("item"))
    return rows.where("chunk_index > 0").select("doc_id", "item").distinct().join(rows.where("chunk_index = 0"), ["doc_id", "item"], "left_anti")


@query("keyword_importance", f"WITH {_k} SELECT keyword, max(importance) AS importance FROM k GROUP BY 1 ORDER BY importance DESC, keyword LIMIT 20", "annotations")
def keyword_importance(spark, sf_dir):
    g = T.exploded_keywords(load(spark, sf_dir, "annotations")).groupBy("keyword").agg(F.max("importance").alias("importance"))
    return g.orderBy(F.desc("importance"), "keyword").limit(20)


@query("keyword_merge", f"""WITH {_k}, t AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min((chunk_index, ix))) AS r FROM k GROUP BY doc_id, keyword),
 p AS (SELECT doc_id, keyword, 3 AS weight FROM t WHERE r <= 5 UNION ALL SELECT doc_id, d[1 + doc_id % len(d)], 4 FROM (SELECT DISTINCT doc_id, {_list([d.lower() for d in X.DOMAINS])} AS d FROM k)
 UNION ALL SELECT doc_id, keyword, least(5, greatest(1, count(*) // 2 + 1)) FROM k GROUP BY doc_id, keyword) SELECT doc_id, keyword, CAST(max(weight) AS INTEGER) AS weight FROM p GROUP BY ALL""", "annotations")
def keyword_merge(spark, sf_dir):
    k = T.exploded_keywords(load(spark, sf_dir, "annotations"))
    place = F.min(F.struct("chunk_index", "at"))
    ranked = k.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"), place.alias("f"))
    topics = ranked.withColumn("r", F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("n"), "f"))).where("r <= 5").select("doc_id", "keyword", F.lit(3).alias("weight"))
    names = F.array(*[F.lit(d.lower()) for d in X.DOMAINS])
    domains = k.select("doc_id").distinct().select("doc_id", F.get(names, (F.col("doc_id") % len(X.DOMAINS)).cast("int")).alias("keyword"), F.lit(4).alias("weight"))
    counted = k.groupBy("doc_id", "keyword").agg(T.frequency_weight(F.count(F.lit(1))).alias("weight"))
    return T.merged_keywords([topics, domains, counted])


@query("key_topic_line", f"WITH {_k} SELECT doc_id, array_to_string(list_sort(list(DISTINCT keyword))[1:15], ', ') AS topics FROM k GROUP BY doc_id", "annotations")
def key_topic_line(spark, sf_dir):
    k = T.exploded_keywords(load(spark, sf_dir, "annotations"))
    return k.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("keyword")), 1, 15), ", ").alias("topics"))


@query("keyword_frequency", f"WITH {_k} SELECT doc_id, keyword, count(*) AS frequency, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, keyword) AS \"rank\" FROM k GROUP BY doc_id, keyword QUALIFY \"rank\" <= 15", "annotations")
def keyword_frequency(spark, sf_dir):
    g = T.exploded_keywords(load(spark, sf_dir, "annotations")).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("frequency"))
    return g.withColumn("rank", F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "keyword"))).where("rank <= 15")


_top = "SELECT {k}, term, tf, row_number() OVER (PARTITION BY {k} ORDER BY tf DESC, term) AS \"rank\" FROM (SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest({t}) AS term FROM {v}) GROUP BY ALL) QUALIFY \"rank\" <= {n}"
_section = _top.format(k="doc_id, chunk_index", t=_terms("summary", L.SECTION_STOP), v="annotations", n=5)


@query("wordcloud_terms", _top.format(k="doc_id", t=_terms("text", sorted({*L.ENGLISH_STOP, *L.EXTRA_STOP})), v="dossiers", n=100), "dossiers")
def wordcloud_terms(spark, sf_dir):
    return T.wordcloud_terms(load(spark, sf_dir, "dossiers"))


@query("section_topics", _section, "annotations")
def section_topics(spark, sf_dir):
    return T.section_topics(_chunks(spark, sf_dir))


@query("topic_flow", f"""WITH s AS ({_section}), g AS (SELECT a.doc_id, a.term AS from_topic, b.term AS to_topic, count(*) AS n FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.chunk_index = a.chunk_index + 1 GROUP BY ALL)
 SELECT *, n / sum(n) OVER (PARTITION BY doc_id, from_topic) AS prob FROM g""", "annotations")
def topic_flow(spark, sf_dir):
    return T.topic_flow(_chunks(spark, sf_dir))


@query("term_matrix", f"""WITH c AS (SELECT label, term, count(*) AS tf FROM (SELECT source AS label, unnest({_terms('text', L.COLLECTION_STOP)}) AS term FROM documents) GROUP BY ALL), w AS (SELECT term FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 10),
 f AS (SELECT l.label, w.term, coalesce(c.tf, 0) AS tf FROM (SELECT DISTINCT source AS label FROM documents) l CROSS JOIN w LEFT JOIN c ON c.label = l.label AND c.term = w.term)
 SELECT label, term, CASE WHEN sum(tf) OVER (PARTITION BY label) > 0 THEN tf / sum(tf) OVER (PARTITION BY label) END AS share FROM f""")
def term_matrix(spark, sf_dir):
    return T.term_matrix(load(spark, sf_dir, "documents").select(F.col("source").alias("label"), "text"))


_strategies = {"essential": lambda t, n, known: D.essential(t, n, 1, TOKENS), "long": lambda t, n, known: D.long_(t, n, 2, TOKENS, known), "complex": lambda t, n, known: D.complex_(t, n, 2, TOKENS, known)}
_pieces = " UNION ALL ".join(f"SELECT {q(k)} AS strategy, {i} AS o, doc_id, chunk_index, text FROM ({s})" for i, (k, s) in enumerate({"essential": _essential, "long": folds.long_sql("dossiers", 2, TOKENS), "complex": folds.complex_sql("dossiers", _essential_sql, 2, TOKENS)}.items()))
_told = f"SELECT doc_id, strategy, o, count(*) AS divisions, string_agg(list_filter(string_split_regex(trim(text), '[.!?]+\\s+'), lambda x: x <> '')[1], '. ' ORDER BY chunk_index) AS summary FROM ({_pieces}) GROUP BY ALL"


@query("strategy_metrics", f"""WITH s AS (SELECT doc_id, strategy, divisions, length(summary) AS n FROM ({_told})),
 m AS (SELECT *, divisions / max(divisions) OVER (PARTITION BY doc_id) AS ds, n / max(n) OVER (PARTITION BY doc_id) AS ls FROM s)
 SELECT doc_id, strategy, false AS total, divisions, n AS summary_length, round(ds, 9) AS division_share, round(ls, 9) AS length_share FROM m
 UNION ALL SELECT NULL, strategy, true, CAST(sum(divisions) AS BIGINT), CAST(sum(n) AS BIGINT), round(avg(ds), 9), round(avg(ls), 9) FROM m GROUP BY strategy""", "dossiers")
def strategy_metrics(spark, sf_dir):
    return ST.metrics(load(spark, sf_dir, "dossiers"), _strategies, D.COMMON)


_count = lambda x: f"format('{{:,}}', {x})"
_named = "len(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in X.SPEAKERS) + "])))"


@query("comparison_report", f"""WITH s AS ({_told}), g AS (SELECT doc_id, string_agg('| ' || strategy || ' | ' || {_count('divisions')} || ' | ' || {_count('length(summary)')} || ' chars |', chr(10) ORDER BY o) AS lines,
  string_agg('### ' || upper(substr(strategy, 1, 1)) || substr(strategy, 2) || ' strategy' || chr(10) || CASE WHEN summary = '' THEN {q(ST.NONE)} ELSE summary END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o) AS parts FROM s GROUP BY doc_id)
 SELECT doc_id, concat_ws(chr(10) || chr(10), '# Comparison ' || doc_id, '## Document information' || chr(10) || concat_ws(chr(10), '- Characters: ' || {_count('length(text)')},
  '- Words: ' || {_count("len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))")}, CASE WHEN {_named} > 0 THEN '- Speakers: ' || {_count(_named)} END),
  '## Strategy comparison' || chr(10) || '| Strategy | Divisions | Summary length |' || chr(10) || '|---|---|---|' || chr(10) || lines, '## Strategy summaries' || chr(10) || parts) AS report FROM dossiers JOIN g USING (doc_id)""", "dossiers")
def comparison_report(spark, sf_dir):
    return ST.comparison_report(load(spark, sf_dir, "dossiers"), _strategies, D.COMMON)


@query("run_rollup", "SELECT doc_id, count(*) AS chunks, max(importance) AS top_importance, sum(len(action_items)) AS action_items, sum(len(keywords)) AS keywords FROM annotations GROUP BY doc_id", "annotations")
def run_rollup(spark, sf_dir):
    return load(spark, sf_dir, "annotations").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("importance").alias("top_importance"), F.sum(F.size("action_items")).alias("action_items"), F.sum(F.size("keywords")).alias("keywords"))


@query("category_counts", "SELECT doc_id, CASE WHEN grouping(c) = 1 THEN '(total)' ELSE c END AS category, count(*) AS n FROM (SELECT doc_id, CASE WHEN item_id % 11 = 0 THEN 'Uncategorized' ELSE category END AS c FROM items) GROUP BY GROUPING SETS ((doc_id, c), (doc_id))", "items")
def category_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "items").select("doc_id", F.coalesce(F.when(F.col("item_id") % 11 != 0, F.col("category")), F.lit("Uncategorized")).alias("c"))
    g = rows.rollup("doc_id", "c").agg(F.count(F.lit(1)).alias("n"), F.grouping("c").alias("all"), F.grouping("doc_id").alias("grand"))
    return g.where("grand = 0").select("doc_id", F.when(F.col("all") == 1, "(total)").otherwise(F.col("c")).alias("category"), "n")
