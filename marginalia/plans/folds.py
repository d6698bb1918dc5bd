"""DuckDB SQL of the greedy division folds, as recursive queries over tables of breaks."""

from __future__ import annotations

from ..functions.text import SPEAKERS, STRUCTURE as HEADINGS
from ..operators import divide as D
from ..registry import literal as q


def starts(pattern: str, text: str = "text") -> str:
    """List of match starts: lengths of what lies between and of matches, summed up."""
    between = f"string_split_regex({text}, {q(pattern)})"
    found = f"regexp_extract_all({text}, {q(pattern)})"
    before = f"list_sum(list_transform({between}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i-1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: CAST({before} AS INTEGER))"


def rows_of(cuts: str, kind: str, view: str) -> str:
    """Chunk rows from a table of inner cuts (doc_id, e, kind), closed at the text's end."""
    return f"""z AS (SELECT doc_id, e, kind FROM {cuts} UNION ALL SELECT doc_id, length(text), {q(kind)} FROM {view}),
 y AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS s, e, kind FROM z)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, kind AS chunk_type,
 substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS text FROM y JOIN {view} USING (doc_id) WHERE e > s"""


def structural_ctes(view: str, least: int) -> str:
    """``sc``: inner cuts of the structural rule; every text of the view must have a break."""
    late = (r"\n\s*\n", r"\n")
    breaks = " UNION ALL ".join(f"SELECT doc_id, pos, {k} AS p, {s}::DOUBLE AS w FROM (SELECT doc_id, unnest({starts(x)}) AS pos FROM {view})" + (" WHERE pos > 10" if x in late else "") for k, (x, s) in enumerate(D.STRUCTURE))
    return f"""sb AS MATERIALIZED (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos, p) AS k FROM ({breaks})),
 sd AS MATERIALIZED (SELECT doc_id, length(text) / {least} AS t, CAST(least(floor((length(text) // {least}) * 1.2), 16000) AS INTEGER) AS most FROM {view}),
 sf AS (SELECT doc_id, 0::BIGINT AS k, 0 AS s, NULL::INTEGER AS best, 0.0::DOUBLE AS score, NULL::INTEGER AS cut1, false AS hard, NULL::INTEGER AS cut2 FROM sd
 UNION ALL SELECT doc_id, k, CASE WHEN NOT act THEN s WHEN take THEN best2 ELSE s1 END, CASE WHEN NOT act THEN best WHEN take THEN NULL ELSE best2 END, CASE WHEN NOT act THEN score WHEN take THEN 0.0 ELSE score2 END,
  CASE WHEN act AND ov THEN s1 END, act AND hd, CASE WHEN act AND take THEN best2 END FROM (
  SELECT f.doc_id, b.k, f.s, f.best, f.score, b.pos > f.s AS act, b.pos - f.s > d.most AS ov, ov AND f.best IS NULL AS hd, CASE WHEN ov THEN coalesce(f.best, f.s + d.most) ELSE f.s END AS s1,
   CASE WHEN ov THEN NULL ELSE f.best END AS best1, CASE WHEN ov THEN 0.0 ELSE f.score END AS score1, b.pos - s1 AS size, b.w * greatest(0.5::DOUBLE, 1.0::DOUBLE - abs(size - d.t) / d.t) AS new,
   CASE WHEN new > score1 THEN b.pos ELSE best1 END AS best2, greatest(score1, new) AS score2, size >= d.t * 0.8::DOUBLE AND score2 > 0.6::DOUBLE AS take
  FROM sf f JOIN sb b ON b.doc_id = f.doc_id AND b.k = f.k + 1 JOIN sd d ON d.doc_id = f.doc_id)),
 sc AS (SELECT doc_id, cut1 AS e, CASE WHEN hard THEN 'size_limited_segment' ELSE 'structural_segment' END AS kind FROM sf WHERE cut1 IS NOT NULL UNION ALL SELECT doc_id, cut2, 'structural_segment' FROM sf WHERE cut2 IS NOT NULL)"""


def structural_sql(view: str, least: int) -> str:
    return f"WITH RECURSIVE {structural_ctes(view, least)}, {rows_of('sc', 'structural_segment', view)}"


def turns_sql(view: str, least: int) -> str:
    """Speaker turns; texts with few of them go by structure."""
    breaks = " UNION ALL ".join(f"SELECT doc_id, unnest({starts(p)}) AS pos FROM {view}" for p in D.TRANSITIONS)
    rest = f"few AS MATERIALIZED (SELECT * FROM {view} WHERE doc_id NOT IN (SELECT doc_id FROM tn))"
    return f"""WITH RECURSIVE tb AS MATERIALIZED (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ({breaks})),
 tn AS MATERIALIZED (SELECT doc_id, length(text) / greatest({least}, least(n // 10, 20)) AS t, CAST(least(floor((length(text) // {least}) * 1.2), 16000) AS INTEGER) AS most FROM {view} JOIN (SELECT doc_id, count(*) AS n FROM tb GROUP BY 1) USING (doc_id) WHERE n >= {3 * least}),
 tf AS (SELECT doc_id, 0::BIGINT AS k, 0 AS s, 0 AS size, NULL::INTEGER AS cut FROM tn
 UNION ALL SELECT doc_id, k, CASE WHEN c THEN pos ELSE s END, CASE WHEN pos = 0 OR NOT c THEN CASE WHEN pos = 0 THEN size ELSE grown END ELSE 0 END, CASE WHEN c THEN pos END FROM (
  SELECT f.doc_id, b.k, f.s, f.size, b.pos, f.size + b.pos - f.s AS grown, b.pos > 0 AND (grown > n.most OR grown >= n.t * 0.8::DOUBLE) AS c FROM tf f JOIN tb b ON b.doc_id = f.doc_id AND b.k = f.k + 1 JOIN tn n ON n.doc_id = f.doc_id)),
 {rest}, {structural_ctes("few", least)},
 tc AS (SELECT doc_id, cut AS e, 'transcript_segment' AS kind FROM tf WHERE cut IS NOT NULL UNION ALL SELECT doc_id, e, kind FROM sc),
 te AS (SELECT doc_id, e, kind FROM tc UNION ALL SELECT doc_id, length(text), CASE WHEN doc_id IN (SELECT doc_id FROM tn) THEN 'transcript_segment' ELSE 'structural_segment' END FROM {view}),
 ty AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS s, e, kind FROM te)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, kind AS chunk_type,
 substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS text FROM ty JOIN {view} USING (doc_id) WHERE e > s"""


def speakers_sql(view: str, least: int, tokens: int) -> str:
    """Turns packed to 1.2 times the target."""
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM (SELECT doc_id, unnest({starts(D.TURN)} || [length(text)]) AS pos FROM {view})),
 d AS MATERIALIZED (SELECT doc_id, length(text) / greatest({least}, CAST(ceil(length(text) / 4 / {tokens}) AS INTEGER)) AS t FROM {view}),
 f AS (SELECT doc_id, 0::BIGINT AS k, 0 AS s, 0 AS upto, NULL::INTEGER AS cut FROM d
 UNION ALL SELECT doc_id, k, CASE WHEN c THEN upto ELSE s END, pos, CASE WHEN c THEN upto END FROM (SELECT f.doc_id, b.k, f.s, f.upto, b.pos, b.pos - f.s > d.t * 1.2::DOUBLE AND f.upto > f.s AS c FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1 JOIN d ON d.doc_id = f.doc_id)),
 c AS (SELECT doc_id, cut AS e, 'long' AS kind FROM f WHERE cut IS NOT NULL), {rows_of('c', 'long', view)}"""


def teams_sql(view: str, most: int) -> str:
    """Stamped turns packed until a chunk passes ``most``; every text has stamps."""
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM (SELECT doc_id, unnest({starts(D.TEAMS_TURN)}) AS pos FROM {view} WHERE length(text) >= {0.8 * most})),
 f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0 AS s, NULL::INTEGER AS cut FROM b
 UNION ALL SELECT doc_id, k, CASE WHEN c THEN pos ELSE s END, CASE WHEN c THEN pos END FROM (SELECT f.doc_id, b.k, f.s, b.pos, b.pos - f.s > {most} AS c FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)),
 c AS (SELECT doc_id, cut AS e, 'teams' AS kind FROM f WHERE cut IS NOT NULL), {rows_of('c', 'teams', view)}"""


def intervals_sql(view: str, least: int, tokens: int) -> str:
    """Intervals between boundaries, merged while there are more than twice the target."""
    breaks = " UNION ALL ".join(f"SELECT doc_id, unnest({starts(p)}) AS pos FROM {view}" for p in D.BOUNDARIES)
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT doc_id, pos FROM ({breaks})),
 p AS (SELECT doc_id, 0 AS pos FROM {view} WHERE doc_id IN (SELECT doc_id FROM b) UNION SELECT doc_id, pos FROM b UNION SELECT doc_id, length(text) FROM {view}),
 i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, pos AS s, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM p) WHERE e - s >= 200),
 d AS MATERIALIZED (SELECT doc_id, text, length(text) AS len, greatest({least}, CAST(ceil(length(text) / 4 / {tokens}) AS INTEGER)) AS n FROM {view}),
 f AS (SELECT i.doc_id, k, s, e, NULL::INTEGER AS os, NULL::INTEGER AS oe FROM i JOIN d USING (doc_id) WHERE k = 1 AND m > 2 * n
 UNION ALL SELECT doc_id, k, CASE WHEN fits THEN s ELSE ns END, ne, CASE WHEN NOT fits THEN s END, CASE WHEN NOT fits THEN e END FROM (
  SELECT f.doc_id, i.k, f.s, f.e, i.s AS ns, i.e AS ne, (f.e - f.s) + (i.e - i.s) < (d.len / d.n) * 1.5::DOUBLE AS fits FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1 JOIN d ON d.doc_id = f.doc_id)),
 o AS (SELECT doc_id, os AS s, oe AS e FROM f WHERE os IS NOT NULL UNION ALL SELECT doc_id, arg_max(s, k), arg_max(e, k) FROM f GROUP BY doc_id UNION ALL SELECT i.doc_id, s, e FROM i JOIN d USING (doc_id) WHERE m <= 2 * n)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, 'complex' AS chunk_type, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS text FROM o JOIN d USING (doc_id)"""


def nearest_sql(view: str, pattern: str, sections: int) -> str:
    """The break closest to each ideal edge; those near a chosen one go."""
    best = "list_sort(list_transform(rest, lambda b: {'d': abs(b - floor((i + 1) * ideal)), 'b': b}))[1].b"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, length(text) / {sections} AS ideal, {starts(pattern)} AS breaks FROM {view}),
 f AS (SELECT doc_id, 0 AS i, ideal, breaks AS rest, []::INTEGER[] AS o FROM p WHERE len(breaks) > {sections - 1}
 UNION ALL SELECT doc_id, i + 1, ideal, CASE WHEN len(rest) = 0 THEN rest ELSE list_filter(rest, lambda b: abs(b - best) > ideal * 0.3::DOUBLE) END, CASE WHEN len(rest) = 0 THEN o ELSE list_append(o, best) END FROM (SELECT *, {best} AS best FROM f WHERE i < {sections - 1})),
 g AS (SELECT doc_id, list_sort(list_distinct(o)) AS o FROM f WHERE i = {sections - 1} UNION ALL SELECT doc_id, list_sort(list_distinct(breaks)) FROM p WHERE len(breaks) <= {sections - 1})
 SELECT doc_id, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS k, unnest(o) AS pos FROM g"""


def size_sql(view: str, most: int) -> str:
    """About equal parts closed at the last paragraph or else sentence break in reach."""

    def last(part: str, hi: str) -> str:
        w = f"substr(text, CAST(s + 1 AS BIGINT), CAST({hi} - s AS BIGINT))"
        return f"CASE WHEN contains({w}, {part}) THEN s + length({w}) - (instr(reverse({w}), reverse({part})) - 1) - length({part}) ELSE -1 END"

    marks = ", ".join(last(x, "aim + 200") for x in ("'. '", "'! '", "'? '"))
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n, CAST(greatest(1, floor(length(text) / ceil(length(text) / {most}))) AS BIGINT) AS t FROM {view} WHERE length(text) > {most}),
 f AS (SELECT doc_id, 0::BIGINT AS s FROM d UNION ALL SELECT doc_id, CASE WHEN aim >= n THEN aim WHEN p >= 0 THEN p + 2 WHEN r >= 0 THEN r + 2 ELSE aim END FROM (
  SELECT doc_id, n, aim, {last("chr(10) || chr(10)", "aim + 500").replace("reverse(chr(10) || chr(10))", "(chr(10) || chr(10))").replace("length(chr(10) || chr(10))", "2").replace(", chr(10) || chr(10))", ", (chr(10) || chr(10)))")} AS p, greatest({marks}) AS r FROM (SELECT f.doc_id, f.s, d.text, d.n, least(f.s + d.t, d.n) AS aim FROM f JOIN d USING (doc_id) WHERE f.s < d.n))),
 c AS (SELECT f.doc_id, s AS e, 'size' AS kind FROM f JOIN d USING (doc_id) WHERE s > 0 AND s < n), {rows_of('c', 'size', view)}"""


def paragraph_ctes(view: str, most: int = 1000) -> str:
    """``pp``: (doc_id, para_index, text) of paragraphs; larger ones packed from sentences."""
    return rf"""pr AS MATERIALIZED (SELECT doc_id, i, regexp_replace(ps[i], '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS ps FROM {view}))),
 pl AS MATERIALIZED (SELECT doc_id, i, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM pr WHERE length(p) > {most}),
 pf AS (SELECT doc_id, i, 1::BIGINT AS k, parts[1] AS part, length(parts[1]) AS size, 0 AS g FROM pl
 UNION ALL SELECT f.doc_id, f.i, f.k + 1, l.parts[f.k + 1], CASE WHEN f.size + length(l.parts[f.k + 1]) > {most} THEN length(l.parts[f.k + 1]) ELSE f.size + length(l.parts[f.k + 1]) END, CASE WHEN f.size + length(l.parts[f.k + 1]) > {most} THEN f.g + 1 ELSE f.g END
  FROM pf f JOIN pl l ON l.doc_id = f.doc_id AND l.i = f.i WHERE f.k < len(l.parts)),
 pp AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, g) - 1 AS INTEGER) AS para_index, text FROM (SELECT doc_id, i, g, string_agg(part, ' ' ORDER BY k) AS text FROM pf GROUP BY doc_id, i, g UNION ALL SELECT doc_id, i, 0, p FROM pr WHERE p <> '' AND length(p) <= {most}))"""


def sections_sql(view: str, bounds: str, tokens: int) -> str:
    """Paragraphs with section and subsection; ``bounds`` gives (doc_id, boundary)."""
    return f"""WITH RECURSIVE {paragraph_ctes(view)}, bo AS MATERIALIZED ({bounds}),
 r AS (SELECT doc_id, para_index, length(text) // 4 AS t, (SELECT count(DISTINCT boundary) FROM bo WHERE bo.doc_id = pp.doc_id AND boundary <= para_index) AS section FROM pp WHERE doc_id IN (SELECT doc_id FROM bo)),
 n AS MATERIALIZED (SELECT *, row_number() OVER g AS k, sum(t) OVER (PARTITION BY doc_id, section) > {tokens} * 1.2::DOUBLE AND count(*) OVER (PARTITION BY doc_id, section) > 3 AS large FROM r WINDOW g AS (PARTITION BY doc_id, section ORDER BY para_index)),
 f AS (SELECT doc_id, section, k, para_index, t AS size, 0 AS sub FROM n WHERE k = 1 AND large
 UNION ALL SELECT f.doc_id, f.section, n.k, n.para_index, CASE WHEN f.size + n.t > {tokens} AND f.size > 0 THEN n.t ELSE f.size + n.t END, CASE WHEN f.size + n.t > {tokens} AND f.size > 0 THEN f.sub + 1 ELSE f.sub END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.section = f.section AND n.k = f.k + 1)
 SELECT doc_id, para_index, CAST(section AS INTEGER) AS section, sub AS subsection FROM f UNION ALL SELECT doc_id, para_index, CAST(section AS INTEGER), 0 FROM n WHERE NOT large"""


def break_rows(view: str, pattern: str) -> str:
    """As ``starts``, in rows (doc_id, pos); blanks between a sentence end and a capital are found
    without lookaround."""
    ahead = 0
    if pattern == r"(?<=[.!?])\s+(?=[A-Z])":
        pattern, ahead = r"[.!?]\s+[A-Z]", 1
    return f"""SELECT doc_id, CAST(sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) + {ahead} AS INTEGER) AS pos FROM (
  SELECT doc_id, unnest(string_split_regex(text, {q(pattern)})[1:len(ms)]) AS b, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {q(pattern)}) AS ms FROM {view}))"""


def topic_ctes(view: str, least: int, tokens: int) -> str:
    """``xc``: inner cuts at the topic breaks closest to ideal edges; every text has breaks."""
    breaks = " UNION ALL ".join(break_rows(view, p) for p in D.TOPICS)
    best = "list_sort(list_transform(rest, lambda b: {'d': abs(b - floor((i + 1) * ideal)), 'b': b}))[1].b"
    return f"""xb AS (SELECT doc_id, list(pos ORDER BY pos) AS breaks FROM ({breaks}) GROUP BY doc_id),
 xd AS MATERIALIZED (SELECT doc_id, greatest({least}, CAST(ceil(length(text) / 4 / {tokens}) AS INTEGER)) AS n, length(text) / greatest({least}, CAST(ceil(length(text) / 4 / {tokens}) AS INTEGER)) AS ideal, breaks FROM {view} JOIN xb USING (doc_id)),
 xf AS (SELECT doc_id, 0 AS i, n, ideal, breaks AS rest, NULL::INTEGER AS cut FROM xd WHERE len(breaks) > n - 1
 UNION ALL SELECT doc_id, i + 1, n, ideal, list_filter(rest, lambda b: abs(b - best) > ideal * 0.3::DOUBLE), best FROM (SELECT *, {best} AS best FROM xf WHERE i < n - 1 AND len(rest) > 0)),
 xc AS (SELECT DISTINCT doc_id, cut AS e, 'long' AS kind FROM xf WHERE cut > 0 UNION SELECT doc_id, e, 'long' FROM (SELECT doc_id, unnest(breaks) AS e FROM xd WHERE len(breaks) <= n - 1) WHERE e > 0)"""


def topics_sql(view: str, least: int, tokens: int) -> str:
    return f"WITH RECURSIVE {topic_ctes(view, least, tokens)}, {rows_of('xc', 'long', view)}"


def long_sql(view: str, least: int, tokens: int) -> str:
    """By speakers where a text names some, else by topics."""
    named = " OR ".join(f"regexp_matches(text, {q(p)})" for p in SPEAKERS)
    return f"""WITH RECURSIVE sv AS MATERIALIZED (SELECT doc_id, text FROM {view} WHERE {named}), tv AS MATERIALIZED (SELECT doc_id, text FROM {view} WHERE NOT ({named})),
 {topic_ctes("tv", least, tokens)}, sp AS MATERIALIZED ({speakers_sql("sv", least, tokens)}),
 tp AS MATERIALIZED (WITH {rows_of('xc', 'long', 'tv')}) SELECT * FROM sp UNION ALL SELECT * FROM tp"""


def even_sql(view: str, least: int) -> str:
    """Chunks that end at the sentence end nearest to the target; texts without one in slices."""
    at = "list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS INTEGER))"
    near = "list_sort(list_transform(list_filter(e.ends, lambda b: b > f.e AND abs(b - least(f.e + e.t, n)) <= 0.3::DOUBLE * e.t), lambda b: {'d': abs(b - least(f.e + e.t, n)), 'b': b}))[1].b"
    return rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, text, length(text) AS n, string_split_regex(text, '[.!?]\s+') AS ps, regexp_extract_all(text, '[.!?]\s+') AS ms FROM {view}),
 e AS MATERIALIZED (SELECT doc_id, text, n, greatest(1.0::DOUBLE, least(CAST(least(floor((n // {least}) * 1.2::DOUBLE), 16000) AS DOUBLE), n / {least})) AS t, {at} AS ends FROM p),
 f AS (SELECT doc_id, 0 AS e FROM e WHERE len(ends) > 0 UNION ALL SELECT f.doc_id, coalesce({near}, CAST(least(f.e + floor(e.t), n) AS INTEGER)) FROM f JOIN e USING (doc_id) WHERE f.e < e.n),
 c AS (SELECT f.doc_id, f.e, 'sentence_boundary_segment' AS kind FROM f JOIN e USING (doc_id) WHERE f.e > 0 AND f.e < n
  UNION ALL SELECT doc_id, e, 'even_segment' FROM (SELECT doc_id, n, unnest(range(1, {least})) * (n // {least}) AS e FROM e WHERE len(ends) = 0) WHERE e > 0 AND e < n),
 ks AS (SELECT doc_id, CASE WHEN len(ends) = 0 THEN 'even_segment' ELSE 'sentence_boundary_segment' END AS k FROM e),
 {rows_of('c', 'sentence_boundary_segment', view).replace("kind AS chunk_type", "(SELECT k FROM ks WHERE ks.doc_id = y.doc_id) AS chunk_type")}"""


def chunks_sql(view: str, like: str, least: int) -> str:
    """By turns where a text is like a transcript, else by structure, evenly if that makes too
    few; with the place of each chunk."""
    return f"""WITH RECURSIVE lv AS MATERIALIZED (SELECT doc_id, text FROM {view} WHERE {like}), ov AS MATERIALIZED (SELECT doc_id, text FROM {view} WHERE NOT ({like})),
 sm AS MATERIALIZED (SELECT * FROM ({turns_sql("lv", least)}) UNION ALL SELECT * FROM ({structural_sql("ov", least)})),
 en AS MATERIALIZED (SELECT doc_id FROM sm GROUP BY 1 HAVING count(*) >= {least}), ev AS MATERIALIZED (SELECT doc_id, text FROM {view} WHERE doc_id NOT IN (SELECT doc_id FROM en)),
 al AS MATERIALIZED (SELECT * FROM sm WHERE doc_id IN (SELECT doc_id FROM en) UNION ALL SELECT * FROM ({even_sql("ev", least)})),
 c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM al)
 SELECT doc_id, chunk_index, start_pos, end_pos, chunk_type, text, CASE WHEN n = 1 THEN 'full_document' WHEN chunk_index = 0 THEN 'introduction' WHEN chunk_index = n - 1 THEN 'conclusion' WHEN n <= 4 THEN 'middle'
 WHEN chunk_index < greatest(1, n // 4) THEN 'early' WHEN chunk_index >= greatest(n - greatest(1, n // 4) - 1, 3 * n // 4) THEN 'late' ELSE 'middle' END AS position FROM c"""


def context_sql(view: str, least: int, tokens: int) -> str:
    """Sections that end at the break of most adjusted strength near the target size, else at a
    sentence end; every text has breaks."""
    found = " UNION ALL ".join(f"SELECT doc_id, pos, {k} AS p, {s}::DOUBLE AS w FROM ({break_rows(view, x)})" for k, (x, s) in enumerate(D.CONTEXT))
    window = "substr(text, CAST(lo + 1 AS BIGINT), CAST(hard - lo AS BIGINT))"
    marks = ", ".join(f"CASE WHEN contains({window}, {x}) THEN lo + length({window}) - (instr(reverse({window}), reverse({x})) - 1) - 2 ELSE -1 END" for x in ("'. '", "'! '", "'? '"))
    factor = "CASE WHEN b.pos - s BETWEEN t * 0.8::DOUBLE AND t * 1.2::DOUBLE THEN 1.2::DOUBLE WHEN b.pos - s < t * 0.5::DOUBLE THEN 0.8::DOUBLE WHEN b.pos - s > t * 1.5::DOUBLE THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""WITH RECURSIVE cb AS (SELECT doc_id, list({{'i': i, 'pos': pos, 'w': w}} ORDER BY i) AS bl FROM (SELECT doc_id, pos, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos, p) AS i FROM ({found})) GROUP BY doc_id),
 ct AS (SELECT doc_id, text, length(text) AS n, greatest(1.0::DOUBLE, length(text) / greatest({least}, CAST(ceil(length(text) / 4 / {tokens}) AS INTEGER))) AS t, bl FROM {view} JOIN cb USING (doc_id)),
 cd AS MATERIALIZED (SELECT *, greatest(1000.0::DOUBLE, floor(t / 3)) AS small, CAST(floor(t * 0.2::DOUBLE) AS INTEGER) AS back FROM ct),
 cf AS (SELECT doc_id, 0::BIGINT AS s FROM cd
 UNION ALL SELECT doc_id, coalesce(best, CASE WHEN hard < n AND mark >= 0 AND mark + 2 > s THEN mark + 2 ELSE hard END) FROM (SELECT *, greatest({marks}) AS mark,
   list_sort(list_transform(list_filter(bl, lambda b: b.pos - s >= small AND b.pos > s AND b.i <= stop), lambda b: {{'v': -(b.w * {factor}), 'i': b.i, 'pos': b.pos}}))[1].pos AS best FROM (
  SELECT f.s, d.*, least(f.s + CAST(floor(d.t) AS INTEGER), d.n) AS hard, greatest(0, least(f.s + CAST(floor(d.t) AS INTEGER), d.n) - d.back) AS lo,
   coalesce(list_min(list_transform(list_filter(d.bl, lambda b: b.pos > f.s + d.t * 1.5::DOUBLE), lambda b: b.i)), 2147483647) AS stop FROM cf f JOIN cd d USING (doc_id) WHERE f.s < d.n))),
 cc AS (SELECT f.doc_id, s AS e, 'complex' AS kind FROM cf f JOIN cd d USING (doc_id) WHERE s > 0 AND s < n),
 ca AS MATERIALIZED (WITH {rows_of('cc', 'complex', view)})
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1 AS INTEGER) AS chunk_index, start_pos, end_pos, chunk_type, text FROM ca WHERE regexp_matches(text, '\\S')"""


def complex_sql(view: str, essential, least: int, tokens: int) -> str:
    """Of structure and context the division whose count is closest to the target, else
    ``essential(view, least)``."""
    both = f"na >= {least} AND (nb < {least} OR abs(na - target) <= abs(nb - target))"
    return f"""WITH RECURSIVE ga AS MATERIALIZED ({intervals_sql(view, least, tokens)}), gb AS MATERIALIZED ({context_sql(view, least, tokens)}),
 gc AS MATERIALIZED (SELECT doc_id, CASE WHEN {both} THEN 'a' WHEN nb >= {least} THEN 'b' ELSE 'c' END AS pick FROM (SELECT doc_id, greatest({least}, length(text) // {4 * tokens}) AS target,
  (SELECT count(*) FROM ga WHERE ga.doc_id = v.doc_id) AS na, (SELECT count(*) FROM gb WHERE gb.doc_id = v.doc_id) AS nb FROM {view} v)),
 ge AS MATERIALIZED (SELECT doc_id, text FROM {view} WHERE doc_id IN (SELECT doc_id FROM gc WHERE pick = 'c'))
 SELECT * FROM ga WHERE doc_id IN (SELECT doc_id FROM gc WHERE pick = 'a') UNION ALL SELECT * FROM gb WHERE doc_id IN (SELECT doc_id FROM gc WHERE pick = 'b') UNION ALL SELECT * FROM ({essential('ge', least)})"""


def divided_sql(view: str, strategy: str, essential, tokens: int) -> str:
    """By a strategy expression; ``auto`` by the opening 2000 characters and the length."""
    some = lambda patterns: "(" + " OR ".join(f"regexp_matches(substr(text, 1, 2000), {q(p)})" for p in patterns) + ")"
    auto = f"CASE WHEN {some(SPEAKERS)} THEN 'long' WHEN {some(HEADINGS)} THEN 'complex' WHEN length(text) / 4 > 50000 THEN 'long' ELSE 'essential' END"
    return f"""WITH RECURSIVE hv AS MATERIALIZED (SELECT doc_id, text, CASE WHEN {strategy} = 'auto' THEN {auto} ELSE {strategy} END AS name FROM {view}),
 hl AS MATERIALIZED (SELECT doc_id, text FROM hv WHERE name = 'long'), hc AS MATERIALIZED (SELECT doc_id, text FROM hv WHERE name = 'complex'), he AS MATERIALIZED (SELECT doc_id, text FROM hv WHERE name NOT IN ('long', 'complex'))
 SELECT * FROM ({long_sql('hl', 2, tokens)}) UNION ALL SELECT * FROM ({complex_sql('hc', essential, 2, tokens)}) UNION ALL SELECT * FROM ({essential('he', 1)})"""
