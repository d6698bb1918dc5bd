"""Action, issue, similarity and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import lists as L
from ..functions.breaks import starts
from ..operators import actions as A
from ..operators import commitments as CM
from ..operators import intervals as I
from ..operators import similar as S
from ..registry import literal as q
from ..registry import query
from ..sources.scratch import cut
from ..views import load

ORDER = {"High": 3, "Medium": 2, "Low": 1}
_rank = "CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
_ratio = "(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 WHEN least(length({a}), length({b})) < 0.4 * greatest(length({a}), length({b})) THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"
#: DuckDB's edit distance counts bytes: for it each letter beyond ASCII that the given tables hold is
#: one control character, so that bytes are characters. Tables with other letters need a longer list.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_one = "translate({}, " + q(_WIDE) + ", " + " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 27)]) + ")"
_norm = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


_lines = "list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(trim(x), '^[-*]')), lambda x: trim(x))"
_texts = "CASE WHEN doc_id % 3 = 0 THEN 'To do: ' || array_to_string(action_items, ', ') ELSE array_to_string(list_transform(action_items, lambda x: '- ' || x), chr(10)) END"
_given = f"SELECT * EXCLUDE (action_items, t), CASE WHEN len({_lines}) > 0 THEN {_lines} ELSE [trim(t)] END AS action_items FROM (SELECT *, {_texts} AS t FROM annotations WHERE doc_id % 2 = 0) UNION ALL BY NAME SELECT * FROM annotations WHERE doc_id % 2 = 1"


@query("action_candidates", f"SELECT doc_id, chunk_index AS source_chunk, CAST(generate_subscripts(action_items, 1) - 1 AS INTEGER) AS place, trim(regexp_replace(trim(unnest(action_items)), '^[-*]', '')) AS text, position, importance, speakers FROM ({_given})", "annotations")
def action_candidates(spark, sf_dir):
    """Items come as lists, in every second document as one text, with bullets or without."""
    notes = load(spark, sf_dir, "annotations")
    bullets = F.array_join(F.transform("action_items", lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("To do: "), F.array_join("action_items", ", "))).otherwise(bullets)
    as_texts = notes.where("doc_id % 2 = 0").withColumn("action_items", text)
    return A.candidates(notes.where("doc_id % 2 = 1")).union(A.candidates(as_texts))


_valid = "SELECT doc_id, idx, c.text, v.score AS validation_score, v.reason FROM candidates c JOIN validation v USING (doc_id, idx) WHERE v.score >= 3"


@query("validated_actions", _valid, "annotations candidates validation")
def validated_actions(spark, sf_dir):
    return A.validated(load(spark, sf_dir, "candidates"), load(spark, sf_dir, "validation")).select("doc_id", "idx", "text", "validation_score", "reason")


@query("scores_to_candidates", "SELECT doc_id, idx, c.text, v.score AS given, v.reason FROM candidates c JOIN validation v USING (doc_id, idx)", "annotations candidates validation")
def scores_to_candidates(spark, sf_dir):
    v = load(spark, sf_dir, "validation").select("doc_id", "idx", F.col("score").alias("given"), "reason")
    return load(spark, sf_dir, "candidates").join(v, ["doc_id", "idx"]).select("doc_id", "idx", "text", "given", "reason")


def _led(doc, idx):
    """Leaders of each document's candidates, item by item, and the leader that each joins."""
    return f"""WITH RECURSIVE c AS (SELECT {doc} AS doc_id, {idx} AS idx, {_one.format(_norm.format("text"))} AS x FROM candidates),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM c),
 f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::STRUCT(i BIGINT, x VARCHAR)[] AS leaders, NULL::BIGINT AS idx, NULL::BIGINT AS group_id FROM o
  UNION ALL SELECT doc_id, k, CASE WHEN len(mine) > 0 THEN leaders ELSE list_append(leaders, {{'i': oi, 'x': ox}}) END, oi, coalesce(mine[1].i, oi) FROM (
   SELECT f.doc_id, o.k, f.leaders, o.idx AS oi, o.x AS ox, list_filter(f.leaders, lambda y: {_ratio.format(a="y.x", b="o.x")} > 0.7) AS mine FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1))"""


_best_sql = _led("doc_id", "idx") + """, g AS (SELECT candidates.*, f.group_id FROM candidates JOIN f USING (doc_id, idx)), w AS (SELECT *, row_number() OVER o AS k, first_value(assignee IGNORE NULLS) OVER f AS who, first_value(due IGNORE NULLS) OVER f AS whn FROM g
 WINDOW o AS (PARTITION BY doc_id, group_id ORDER BY score DESC, importance DESC, assignee IS NOT NULL DESC, due IS NOT NULL DESC, idx), f AS (PARTITION BY doc_id, group_id ORDER BY score DESC, importance DESC, assignee IS NOT NULL DESC, due IS NOT NULL DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT doc_id, idx, text, who AS assignee, whn AS due, score, importance, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, importance DESC, idx) AS "rank" FROM w WHERE k = 1)"""


def _best(spark, sf_dir):
    """The best of each group of similar candidates of a document."""
    items = load(spark, sf_dir, "candidates")
    groups = S.leader_groups(items.select("doc_id", "idx", "text")).select("doc_id", "idx", "group_id")
    return A.prioritised(items.join(groups, ["doc_id", "idx"]))



@query("prioritised_actions", _best_sql + " SELECT * FROM b", "annotations candidates")
def prioritised_actions(spark, sf_dir):
    return _best(spark, sf_dir)


@query("format_actions", _best_sql + """, n AS (SELECT doc_id, idx, due, CASE WHEN assignee IS NOT NULL AND NOT contains(lower(text), lower(assignee)) THEN assignee || ': ' || text ELSE text END AS t FROM b)
 SELECT doc_id, idx, CASE WHEN due IS NOT NULL AND NOT contains(lower(t), lower(due)) THEN t || ' (Due: ' || due || ')' ELSE t END AS action FROM n""", "annotations candidates")
def format_actions(spark, sf_dir):
    return _best(spark, sf_dir).select("doc_id", "idx", A.formatted(F.col("text"), F.col("assignee"), F.col("due")).alias("action"))


@query("priority_rank", f"SELECT item_id, severity, {_rank} AS rank_value FROM items", "items")
def priority_rank(spark, sf_dir):
    return load(spark, sf_dir, "items").select("item_id", "severity", A.priority(F.col("severity"), ORDER).alias("rank_value"))


@query("severity_groups", "SELECT doc_id, CASE lower(severity) WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Other' END AS severity_group, count(*) AS n FROM items GROUP BY ALL", "items")
def severity_groups(spark, sf_dir):
    return load(spark, sf_dir, "items").groupBy("doc_id", A.severity_group(F.col("severity")).alias("severity_group")).agg(F.count(F.lit(1)).alias("n"))


@query("min_severity", f"SELECT item_id, severity FROM items WHERE {_rank} >= 2", "items")
def min_severity(spark, sf_dir):
    return load(spark, sf_dir, "items").where(A.priority(F.col("severity"), ORDER) >= ORDER["Medium"]).select("item_id", "severity")


@query("category_groups", "SELECT doc_id, category, list(title ORDER BY title, item_id) AS titles FROM items GROUP BY ALL", "items")
def category_groups(spark, sf_dir):
    g = load(spark, sf_dir, "items").groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(F.struct("title", "item_id"))).alias("x"))
    return g.select("doc_id", "category", F.col("x.title").alias("titles"))


@query("maturity_rollup", f"""WITH g AS (SELECT doc_id, dimension, level, count(*) AS n, arg_min(evidence, item_id) AS evidence FROM assessments GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, dimension ORDER BY n DESC, level) = 1)
 SELECT doc_id, dimension, level, [{', '.join(map(q, L.LEVELS))}][level] AS level_name, n, evidence, CAST(floor(avg(level) OVER (PARTITION BY doc_id)) AS BIGINT) AS overall FROM b""", "assessments")
def maturity_rollup(spark, sf_dir):
    return A.maturity(load(spark, sf_dir, "assessments"))


@query("default_summary_line", "SELECT doc_id, 'Analysis identified ' || count(*) || ' items across ' || count(DISTINCT category) || ' categories.' AS summary FROM items GROUP BY doc_id", "items")
def default_summary_line(spark, sf_dir):
    g = load(spark, sf_dir, "items").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("k"))
    return g.select("doc_id", F.format_string("Analysis identified %d items across %d categories.", "n", "k").alias("summary"))


_pairs = f"""WITH n AS (SELECT cast(floor(doc_id / 4) AS BIGINT) AS doc_id, doc_id * 10000000 + idx AS idx, {_one.format(_norm.format("text"))} AS x FROM candidates),
 p AS (SELECT a.doc_id, a.idx AS a, b.idx AS b, round({_ratio.format(a="a.x", b="b.x")}, 9) AS ratio FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.idx < b.idx)"""


def _grouped(spark, sf_dir):
    """Candidates of four conversations as those of one document."""
    return load(spark, sf_dir, "candidates").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") * 10000000 + F.col("idx")).alias("idx"), "text")


@query("similar_pairs", _pairs + " SELECT * FROM p WHERE ratio > 0.7", "annotations candidates")
def similar_pairs(spark, sf_dir):
    return S.similar_pairs(_grouped(spark, sf_dir))


@query("leader_groups", _led("cast(floor(doc_id / 4) AS BIGINT)", "doc_id * 10000000 + idx") + " SELECT doc_id, idx, group_id FROM f WHERE k > 0", "annotations candidates")
def leader_groups(spark, sf_dir):
    return S.leader_groups(_grouped(spark, sf_dir))


_kept = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, item_id, {_one.format("title")} AS title, {_one.format("substr(description, 1, 200)")} AS description, row_number() OVER (PARTITION BY doc_id ORDER BY {_rank} DESC, item_id) AS k FROM items),
 f AS (SELECT doc_id, 0 AS k, []::STRUCT(i BIGINT, t VARCHAR, d VARCHAR)[] AS kept FROM o GROUP BY doc_id
  UNION ALL SELECT f.doc_id, o.k, CASE WHEN len(list_filter(f.kept, lambda y: {_ratio.format(a="o.title", b="y.t")} > 0.6 AND {_ratio.format(a="o.description", b="y.d")} > 0.48)) > 0 THEN f.kept ELSE list_append(f.kept, {{'i': o.item_id, 't': o.title, 'd': o.description}}) END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
 l AS (SELECT doc_id, unnest(kept) AS x FROM (SELECT doc_id, arg_max(kept, k) AS kept FROM f GROUP BY doc_id))"""


@query("dedupe_items", _kept + " SELECT doc_id, x.i AS item_id FROM l", "items")
def dedupe_items(spark, sf_dir):
    return S.deduped(load(spark, sf_dir, "items"), A.priority(F.col("severity"), ORDER)).select("doc_id", "item_id")


@query("issue_register", _kept + f" SELECT i.doc_id, i.item_id, i.title, i.category, coalesce(severity, 'Unknown') AS severity, {_rank} AS rank_value FROM l JOIN items i ON i.item_id = l.x.i", "items")
def issue_register(spark, sf_dir):
    rank = A.priority(F.col("severity"), ORDER)
    return S.deduped(load(spark, sf_dir, "items"), rank).select("doc_id", "item_id", "title", "category", F.coalesce("severity", F.lit("Unknown")).alias("severity"), rank.alias("rank_value"))


@query("exact_ratio")
def exact_ratio(spark, sf_dir):
    rows = cut(_grouped(spark, sf_dir).select("doc_id", "idx", S.normalised(F.col("text")).alias("x")), "normalised")
    pairs = S.similar_pairs(rows, 0.5, text="x")
    texts = pairs.join(rows.select("doc_id", F.col("idx").alias("a"), "x"), ["doc_id", "a"]).join(rows.select("doc_id", F.col("idx").alias("b"), F.col("x").alias("y")), ["doc_id", "b"])
    return S.exact_ratio(texts.drop("ratio")).select("doc_id", "a", "b", "ratio")


_tracked = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT company_id AS g, period, item, dense_rank() OVER (PARTITION BY company_id ORDER BY period) AS k, {_one.format(_norm.format("text"))} AS x FROM commitments),
 p AS MATERIALIZED (SELECT a.g, a.k, a.item AS a, b.item AS b, round({_ratio.format(a="a.x", b="b.x")}, 9) AS ratio FROM c a JOIN c b ON a.g = b.g AND b.k = a.k + 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY g, k, b ORDER BY ratio DESC, a) AS i, row_number() OVER (PARTITION BY g, k, a ORDER BY ratio DESC, b) AS j FROM p WHERE ratio > 0.7),
 l AS MATERIALIZED (SELECT g, k, a, b, ratio FROM o WHERE i = 1 AND j = 1),
 h AS (SELECT c.g, c.k, c.item, c.k AS hk, c.item AS hi FROM c LEFT JOIN l ON l.g = c.g AND l.k = c.k - 1 AND l.b = c.item WHERE l.g IS NULL UNION ALL SELECT l.g, l.k + 1, l.b, hk, hi FROM h JOIN l ON l.g = h.g AND l.k = h.k AND l.a = h.item)
 SELECT c.g AS company_id, c.period, c.item, CASE WHEN c.k = 1 THEN 'first' WHEN l.a IS NULL THEN 'new' WHEN l.ratio = 1 THEN 'kept' ELSE 'changed' END AS status, l.a AS previous_item, l.ratio,
  n.a IS NULL AND c.k < max(c.k) OVER (PARTITION BY c.g) AS dropped, f.period AS chain_period, hi AS chain_item
 FROM c LEFT JOIN l ON l.g = c.g AND l.k = c.k - 1 AND l.b = c.item LEFT JOIN l n ON n.g = c.g AND n.k = c.k AND n.a = c.item JOIN h ON h.g = c.g AND h.k = c.k AND h.item = c.item
 JOIN (SELECT DISTINCT g, k, period FROM c) f ON f.g = c.g AND f.k = hk"""


@query("commitment_chains", _tracked, "commitments")
def commitment_chains(spark, sf_dir):
    return CM.tracked(load(spark, sf_dir, "commitments"))


@query("chunk_context", "SELECT a.doc_id, chunk_index, count(*) OVER (PARTITION BY a.doc_id) AS total_chunks, length(t.text) AS original_text_length FROM annotations a JOIN transcripts t USING (doc_id)", "annotations transcripts")
def chunk_context(spark, sf_dir):
    doc = load(spark, sf_dir, "transcripts").select("doc_id", F.length("text").alias("original_text_length"))
    rows = load(spark, sf_dir, "annotations").join(doc, "doc_id")
    return rows.select("doc_id", "chunk_index", F.count(F.lit(1)).over(W.Window.partitionBy("doc_id")).alias("total_chunks"), "original_text_length")


@query("documents_x_labels", """WITH d AS (SELECT doc_id, collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY doc_id) AS i FROM calls), l AS (SELECT collection_id, company, row_number() OVER (PARTITION BY collection_id ORDER BY doc_id) AS i FROM calls WHERE company IS NOT NULL)
 SELECT doc_id, coalesce(company, 'Document ' || d.i) AS label FROM d LEFT JOIN l USING (collection_id, i)""", "calls")
def documents_x_labels(spark, sf_dir):
    i = F.row_number().over(W.Window.partitionBy("collection_id").orderBy("doc_id"))
    calls = load(spark, sf_dir, "calls")
    labels = calls.where("company is not null").select("collection_id", "company", i.alias("i"))
    return calls.select("doc_id", "collection_id", i.alias("i")).join(labels, ["collection_id", "i"], "left").select("doc_id", F.coalesce("company", F.concat(F.lit("Document "), F.col("i").cast("string"))).alias("label"))


@query("division_x_summary", "SELECT a.doc_id, a.chunk_index, b.summary FROM annotations a LEFT JOIN (SELECT * FROM annotations WHERE importance > 2) b USING (doc_id, chunk_index)", "annotations")
def division_x_summary(spark, sf_dir):
    a = load(spark, sf_dir, "annotations")
    return a.select("doc_id", "chunk_index").join(a.where("importance > 2").select("doc_id", "chunk_index", "summary"), ["doc_id", "chunk_index"], "left")


_cats = {"Strategy": "goals and plans", "People": "teams and skills", "Data": "sources and quality"}


@query("category_lookup", "SELECT item_id, category, d AS description FROM items LEFT JOIN (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in _cats.items()) + ") t(category, d) USING (category)", "items")
def category_lookup(spark, sf_dir):
    known = spark.createDataFrame(list(_cats.items()), "category string, description string")
    return load(spark, sf_dir, "items").select("item_id", "category").join(F.broadcast(known), "category", "left")  # one row a configured category


_turn = r"(^|\n)[A-Z][a-z]+: "


@query("turns_in_chunks", f"""WITH t AS (SELECT doc_id, text, length(text) AS n, string_split_regex(text, {q(_turn)}) AS ps, regexp_extract_all(text, {q(_turn)}) AS ms FROM transcripts),
 s AS (SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER))) AS pos FROM t),
 c AS (SELECT doc_id, i AS chunk_index, i * 500 AS s, least(n, (i + 1) * 500) AS e FROM (SELECT doc_id, n, unnest(range(0, n // 500 + 1)) AS i FROM t))
 SELECT s.doc_id, pos, CAST(chunk_index AS INTEGER) AS chunk_index FROM s JOIN c ON s.doc_id = c.doc_id AND pos >= c.s AND pos < c.e""", "transcripts")
def turns_in_chunks(spark, sf_dir):
    t = load(spark, sf_dir, "transcripts")
    turns = t.select("doc_id", F.explode(starts(F.col("text"), _turn)).alias("pos"))
    n = F.length("text")
    chunks = t.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / 500).cast("int"))).alias("chunk_index"))
    chunks = chunks.select("doc_id", "chunk_index", (F.col("chunk_index") * 500).alias("s"), F.least(F.col("n"), (F.col("chunk_index") + 1) * 500).alias("e"))
    return I.containing(turns, chunks.drop("n")).select("doc_id", "pos", "chunk_index")
