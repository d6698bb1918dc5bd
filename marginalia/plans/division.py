"""Division queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.breaks import sized, with_starts
from ..operators import divide as D
from ..registry import query
from ..views import load
from . import folds
from .profile import _like


_ends = "list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS INTEGER))"
_even = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, text, length(text) AS n, string_split_regex(text, '[.!?]\\s+') AS ps, regexp_extract_all(text, '[.!?]\\s+') AS ms FROM dossiers),
 e AS MATERIALIZED (SELECT doc_id, text, n, greatest(1.0, least(CAST(least(floor((n // 3) * 1.2), 16000) AS DOUBLE), n / 3)) AS t, {_ends} AS ends FROM p),
 f AS (SELECT doc_id, 0 AS k, 0 AS s, 0 AS e FROM e
  UNION ALL SELECT f.doc_id, f.k + 1, f.e, coalesce(list_sort(list_transform(list_filter(e.ends, lambda b: b > f.e AND abs(b - least(f.e + e.t, n)) <= 0.3 * e.t), lambda b: {{'d': abs(b - least(f.e + e.t, n)), 'b': b}}))[1].b, CAST(least(f.e + floor(e.t), n) AS INTEGER))
  FROM f JOIN e USING (doc_id) WHERE f.e < e.n)
 SELECT f.doc_id, k - 1 AS chunk_index, s AS start_pos, f.e AS end_pos, 'sentence_boundary_segment' AS chunk_type, substr(text, s + 1, f.e - s) AS text FROM f JOIN e USING (doc_id) WHERE k > 0"""


@query("chunk_even", _even, "dossiers")
def chunk_even(spark, sf_dir):
    return D.exploded(load(spark, sf_dir, "dossiers"), sized(F.col("text"), lambda t, n: D.even(t, n, 3, D.default_size(n, 3))))


@query("chunk_structure", folds.structural_sql("dossiers", 6), "dossiers")
def chunk_structure(spark, sf_dir):
    return D.exploded(load(spark, sf_dir, "dossiers"), sized(F.col("text"), lambda t, n: D.structural(t, n, 6, D.default_size(n, 6))))


@query("chunk_transcript", folds.turns_sql("transcripts", 2), "transcripts")
def chunk_transcript(spark, sf_dir):
    return D.exploded(load(spark, sf_dir, "transcripts"), sized(F.col("text"), lambda t, n: D.by_turns(t, n, 2, D.default_size(n, 2))))


_both = "SELECT doc_id * 2 AS doc_id, text FROM transcripts UNION ALL SELECT doc_id * 2 + 1, text FROM dossiers"
_chunks = f"WITH both_kinds AS MATERIALIZED ({_both}), " + folds.chunks_sql("both_kinds", _like, 3)[len("WITH RECURSIVE ") :]


@query("chunk_document", _chunks, "transcripts dossiers")
def chunk_document(spark, sf_dir):
    both = load(spark, sf_dir, "transcripts").select((F.col("doc_id") * 2).alias("doc_id"), "text").union(load(spark, sf_dir, "dossiers").select(F.col("doc_id") * 2 + 1, "text"))
    return D.position_labels(D.exploded(both, D.chunked(F.col("text"), 3)))


_places = """WITH c AS (SELECT doc_id, chunk_index AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM annotations)
 SELECT doc_id, i AS chunk_index, CASE WHEN n = 1 THEN 'full_document' WHEN i = 0 THEN 'introduction' WHEN i = n - 1 THEN 'conclusion' WHEN n <= 4 THEN 'middle'
 WHEN i < greatest(1, n // 4) THEN 'early' WHEN i >= greatest(n - greatest(1, n // 4) - 1, 3 * n // 4) THEN 'late' ELSE 'middle' END AS position FROM c"""


@query("position_labels", _places, "annotations")
def position_labels(spark, sf_dir):
    return D.position_labels(load(spark, sf_dir, "annotations").select("doc_id", "chunk_index"))


def _placed(spark, sf_dir, *rule):
    n = F.count(F.lit(1)).over(W.Window.partitionBy("doc_id"))
    return load(spark, sf_dir, "annotations").select("doc_id", "chunk_index", D.place(F.col("chunk_index"), n, *rule).alias("position"))


_rule = "WITH c AS (SELECT doc_id, chunk_index AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM annotations) SELECT doc_id, i AS chunk_index, CASE WHEN i = 0 THEN '{}' WHEN i = n - 1 THEN '{}' WHEN i / n < {} THEN 'early' WHEN i / n > {} THEN 'late' ELSE 'middle' END AS position FROM c"


@query("position_role", _rule.format("introduction", "conclusion", 0.3, 0.7), "annotations")
def position_role(spark, sf_dir):
    return _placed(spark, sf_dir, "introduction", "conclusion", 0.3, 0.7)


@query("section_position", _rule.format("beginning", "end", 0.25, 0.75), "annotations")
def section_position(spark, sf_dir):
    return _placed(spark, sf_dir, "beginning", "end", 0.25, 0.75)


TOKENS = 1000  # tokens a section in these queries: the test texts are short


def _window(f, part, at, reach):
    lo = f"greatest(0, {at} - {reach})"
    w = f"substr(text, {lo} + 1, {at} + {reach} - {lo})"
    if f == "last":
        return f"CASE WHEN contains({w}, {part}) THEN {lo} + length({w}) - (instr(reverse({w}), reverse({part})) - 1) - length({part}) ELSE -1 END"
    return f"CASE WHEN contains({w}, {part}) THEN {lo} + instr({w}, {part}) - 1 ELSE -1 END"


_marks = lambda f, at: "greatest(" + ", ".join(_window(f, x, at, 200) for x in ("'. '", "'! '", "'? '")) + ")"
_nn = "chr(10) || chr(10)"
def _essential_sql(view: str, least: int) -> str:
    return f"""WITH d AS (SELECT doc_id, text, length(text) AS len, greatest({least}, CAST(ceil(length(text) / 4 / {TOKENS}) AS INTEGER)) AS n FROM {view}),
 s AS (SELECT *, unnest(range(0, n)) AS i FROM d), b AS (SELECT *, CAST(floor(i * (len / n)) AS INTEGER) AS st, CAST(least(len, floor((i + 1) * (len / n))) AS INTEGER) AS en FROM s),
 w AS (SELECT *, {_window("last", f"({_nn})", "st", 500)} AS p, {_marks("last", "st")} AS m, {_window("first", f"({_nn})", "en", 500)} AS q, {_marks("first", "en")} AS r FROM b),
 x AS (SELECT doc_id, text, i, CASE WHEN i > 0 AND st > 0 THEN CASE WHEN p >= 0 AND abs(p - st) < 500 THEN p + 2 WHEN m >= 0 AND abs(m - st) < 200 THEN m + 2 ELSE st END ELSE st END AS s,
  CASE WHEN i < n - 1 AND en < len THEN CASE WHEN q >= 0 AND abs(q - en) < 500 THEN q WHEN r >= 0 AND abs(r - en) < 200 THEN r + 2 ELSE en END ELSE en END AS e FROM w),
 t AS (SELECT *, substr(text, CAST(s + 1 AS BIGINT), CAST(greatest(0, e - s) AS BIGINT)) AS piece FROM x)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, 'essential' AS chunk_type, piece AS text FROM t WHERE regexp_matches(piece, '\\S')"""


_essential = _essential_sql("dossiers", 1)


@query("divide_essential", _essential, "dossiers")
def divide_essential(spark, sf_dir):
    return D.exploded(load(spark, sf_dir, "dossiers"), sized(F.col("text"), lambda t, n: D.essential(t, n, 1, TOKENS)))


def _register(name, view, make, sql=None, common=()):
    @query(name, sql, view if sql and view != "documents" else "")
    def run(spark, sf_dir):
        docs, known = with_starts(load(spark, sf_dir, view), list(common))
        return D.exploded(docs, sized(F.col("text"), lambda t, n: make(t, n, known) if common else make(t, n)))


_register("divide_long", "dossiers", lambda t, n: D.long_(t, n, 2, TOKENS), folds.long_sql("dossiers", 2, TOKENS))
_register("divide_speakers", "transcripts", lambda t, n: D.by_speakers(t, n, 2, 400), folds.speakers_sql("transcripts", 2, 400))
_register("divide_topics", "dossiers", lambda t, n: D.by_topics(t, n, 2, TOKENS), folds.topics_sql("dossiers", 2, TOKENS))
_register("divide_structure", "dossiers", lambda t, n: D.by_structure(t, n, 2, TOKENS), folds.intervals_sql("dossiers", 2, TOKENS))
_register("divide_context_aware", "dossiers", lambda t, n: D.context_aware(t, n, 2, TOKENS), folds.context_sql("dossiers", 2, TOKENS))
_register("divide_complex", "dossiers", lambda t, n, known: D.complex_(t, n, 2, TOKENS, known), folds.complex_sql("dossiers", _essential_sql, 2, TOKENS), [p for p in D.COMMON if p in D.BOUNDARIES])
_register("divide_document", "dossiers", lambda t, n: D.divided(t, F.element_at(F.array(*map(F.lit, ["essential", "long", "complex", "auto", "other"])), (F.col("doc_id") % 5 + 1).cast("int")), 1, TOKENS), folds.divided_sql("dossiers", "['essential', 'long', 'complex', 'auto', 'other'][doc_id % 5 + 1]", _essential_sql, TOKENS))
_register("divide_teams", "teams_transcripts", lambda t, n: D.teams(t, n, 2000), folds.teams_sql("teams_transcripts", 2000))
_register("divide_by_size", "documents", lambda t, n: D.by_size(t, n, 2000), folds.size_sql("documents", 2000))


@query("nearest_breaks", folds.nearest_sql("dossiers", r"\n", 4), "dossiers")
def nearest_breaks(spark, sf_dir):
    from ..functions.breaks import starts

    text = F.col("text")
    found = D.bound(starts(text, r"\n"), lambda b: sized(text, lambda t, n: D.nearest(b, n, F.lit(4))))
    return load(spark, sf_dir, "dossiers").select("doc_id", F.posexplode(found).alias("k", "pos"))


@query("split_paragraphs", f"WITH RECURSIVE {folds.paragraph_ctes('dossiers')} SELECT doc_id, para_index, text AS paragraph FROM pp", "dossiers")
def split_paragraphs(spark, sf_dir):
    return load(spark, sf_dir, "dossiers").select("doc_id", F.posexplode(D.paragraphs(F.col("text"))).alias("para_index", "paragraph"))


_sim = """WITH v AS (SELECT doc_id, para_index, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY doc_id ORDER BY para_index) AS b FROM paragraph_vectors),
 s AS (SELECT doc_id, para_index, list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) AS similarity FROM v WHERE b IS NOT NULL)"""


@query("adjacent_similarity", _sim + " SELECT doc_id, para_index, round(similarity, 9) AS similarity FROM s", "paragraph_vectors")
def adjacent_similarity(spark, sf_dir):
    return D.adjacent_similarity(load(spark, sf_dir, "paragraph_vectors")).withColumn("similarity", F.round("similarity", 9))


_bounds = _sim + """, d AS (SELECT *, count(*) OVER (PARTITION BY doc_id) + 1 AS n, greatest(0.0, avg(similarity) OVER (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - similarity) AS fall FROM s),
 k AS (SELECT doc_id, para_index, n, row_number() OVER (PARTITION BY doc_id ORDER BY round(fall, 12) DESC, para_index) AS r FROM d WHERE para_index > 0 AND para_index < n - 2)
 SELECT doc_id, CAST(para_index + 1 AS INTEGER) AS boundary FROM k WHERE r <= greatest(2, least(n // 5, 10)) - 1 UNION ALL SELECT DISTINCT doc_id, CAST(n AS INTEGER) FROM d"""


@query("topic_boundaries", _bounds, "paragraph_vectors")
def topic_boundaries(spark, sf_dir):
    return D.topic_boundaries(D.adjacent_similarity(load(spark, sf_dir, "paragraph_vectors")))


@query("semantic_sections", folds.sections_sql("dossiers", _bounds, 300), "dossiers paragraph_vectors")
def semantic_sections(spark, sf_dir):
    paras = load(spark, sf_dir, "dossiers").select("doc_id", F.posexplode(D.paragraphs(F.col("text"))).alias("para_index", "text"))
    return D.semantic_sections(paras, topic_boundaries(spark, sf_dir), 300)


_counted = lambda sql: f"(SELECT doc_id, count(*) AS k FROM ({sql}) GROUP BY 1)"
_compared = f"""SELECT v.doc_id, CAST(length(text) AS INTEGER) AS text_length, CAST(length(text) // 4 AS BIGINT) AS estimated_tokens, CAST(coalesce(e.k, 0) AS INTEGER) AS essential, CAST(coalesce(l.k, 0) AS INTEGER) AS long, CAST(coalesce(c.k, 0) AS INTEGER) AS complex
 FROM dossiers v LEFT JOIN {_counted(_essential)} e USING (doc_id) LEFT JOIN {_counted(folds.long_sql("dossiers", 2, TOKENS))} l USING (doc_id) LEFT JOIN {_counted(folds.complex_sql("dossiers", _essential_sql, 2, TOKENS))} c USING (doc_id)"""


@query("compare_strategies", _compared, "dossiers")
def compare_strategies(spark, sf_dir):
    t, n = F.col("text"), F.length("text")
    docs, known = with_starts(load(spark, sf_dir, "dossiers"), D.COMMON)
    on = lambda f: sized(t, f)
    strategies = {"essential": on(lambda t, n: D.essential(t, n, 1, TOKENS)), "long": on(lambda t, n: D.long_(t, n, 2, TOKENS, known)), "complex": on(lambda t, n: D.complex_(t, n, 2, TOKENS, known))}
    return docs.select("doc_id", n.alias("text_length"), F.floor(n / 4).alias("estimated_tokens"), *[F.size(c).alias(k) for k, c in strategies.items()])


@query("detail_scaling", "SELECT doc_id, detail, 3 * CASE detail WHEN 'essential' THEN 1 WHEN 'detailed' THEN 2 WHEN 'detailed-complex' THEN 3 ELSE 1 END AS min_chunks FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'essential' WHEN 1 THEN 'detailed' WHEN 2 THEN 'detailed-complex' ELSE 'other' END AS detail FROM documents)")
def detail_scaling(spark, sf_dir):
    i = F.col("doc_id") % 4
    detail = F.when(i == 0, "essential").when(i == 1, "detailed").when(i == 2, "detailed-complex").otherwise("other")
    factor = F.when(F.col("detail") == "detailed", 2).when(F.col("detail") == "detailed-complex", 3).otherwise(1)
    return load(spark, sf_dir, "documents").select("doc_id", detail.alias("detail")).withColumn("min_chunks", 3 * factor)


@query("section_lengths", f"SELECT doc_id, chunk_index, length(text) AS characters FROM ({_essential})", "dossiers")
def section_lengths(spark, sf_dir):
    return divide_essential(spark, sf_dir).select("doc_id", "chunk_index", F.length("text").alias("characters"))


_levels = "WITH c AS (SELECT doc_id, count(*) AS n FROM annotations GROUP BY 1) SELECT doc_id, n AS level1, CASE WHEN n <= 3 THEN 1 ELSE n // 3 END AS level2, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS level3 FROM c"


@query("hierarchy_counts", _levels, "annotations")
def hierarchy_counts(spark, sf_dir):
    n = F.col("level1")
    g = load(spark, sf_dir, "annotations").groupBy("doc_id").agg(F.count(F.lit(1)).alias("level1"))
    return g.withColumns({"level2": F.when(n <= 3, 1).otherwise(F.floor(n / 3)), "level3": F.when(F.col("doc_id") % 3 == 2, 1).otherwise(0)})
