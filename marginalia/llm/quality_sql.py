"""The quality rules as DuckDB SQL, step by step as ``quality_mcd`` has them."""

from __future__ import annotations

from .quality_mcd import COVS, D, FALL, FLOORS, MEANS, PAIRS, PRIOR, SHARE, STEPS, TAIL, WIDE, chi2_point, chi2_tail

_BASE = r"""d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS r FROM rep, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
b AS MATERIALIZED (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 CAST(len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
 coalesce(r, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN cov USING (doc_id)),
f AS MATERIALIZED (SELECT *, ln((word_chars + 100) / (n_words + 20)) AS x0, ln(1 + 100 * n_symbols / (word_chars + 50)) AS x1, n_repeat_words / (n_words + 50) AS x2, ln(1 + 20 * n_dup_lines / (n_words + 50)) AS x3,
 's' || coalesce(lang, '-') || '|' || coalesce(source, '-') AS ks, 'l' || coalesce(lang, '-') AS kl, 'a' AS ka FROM b),
x AS MATERIALIZED (SELECT unnest([ks, kl, ka]) AS key, unnest([kl, ka, '']) AS parent, x0, x1, x2, x3 FROM f WHERE NOT base_failed)"""

_MEANS = ", ".join(MEANS)
_FACTOR = ", ".join(f"l{i}{j}" for i in range(D) for j in range(i + 1))
_KEPT = ", ".join([*MEANS, *COVS])


def _distance() -> str:
    cols = []
    for i in range(D):
        rest = "".join(f" - l{i}{j} * z{j}" for j in range(i))
        cols.append(f"(x{i} - m{i}{rest}) / l{i}{i} AS z{i}")
    return ", ".join(cols) + ", " + " + ".join(f"z{i} * z{i}" for i in range(D)) + " AS d2"


def _factored(source: str) -> str:
    cols = []
    for j in range(D):
        cols.append(f"sqrt(c{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + f") AS l{j}{j}")
        cols += [f"(c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, D)]
    return f"SELECT *, {', '.join(cols)} FROM ({source})"


def _drawn(level: str, to: str) -> str:
    w = f"(n / (n + {PRIOR}))"
    apart = [f"(b.m{i} - o.m{i})" for i in range(D)]
    cols = [f"{w} * b.m{i} + (1 - {w}) * o.m{i} AS m{i}" for i in range(D)]
    cols += [f"{w} * b.c{i}{j} + (1 - {w}) * o.c{i}{j} + {w} * (1 - {w}) * {apart[i]} * {apart[j]} AS c{i}{j}" for i, j in PAIRS]
    return f"SELECT b.key, {', '.join(cols)} FROM best b JOIN {to} o ON b.parent = o.key WHERE b.key[1] = '{level}'"


def quality_sql() -> str:
    floor = {i: repr(FLOORS[i] ** 2) + "::DOUBLE" for i in range(D)}
    plus = lambda i, j: f" + {floor[i]}" if i == j else ""
    long = " UNION ALL ".join(f"SELECT key, parent, {i} AS f, x{i} AS v FROM x" for i in range(D))
    at = lambda p: f"min(bin) FILTER (upto >= total * {p}) / 64.0::DOUBLE"
    first = ", ".join(f"max(mid) FILTER (f = {i}) AS m{i}, sqrt(max(((hi - lo) / 1.349::DOUBLE) * ((hi - lo) / 1.349::DOUBLE)) FILTER (f = {i}) + {floor[i]}) AS s{i}" for i in range(D))
    z = ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in range(D))
    r = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(D)) + " + 1e-9::DOUBLE) AS r"
    sums = ", ".join([f"avg(z{i}) AS d{i}" for i in range(D)] + [f"avg(z{i} * z{j}) AS p{i}{j}, avg((z{i} / r) * (z{j} / r)) AS u{i}{j}" for i, j in PAIRS])
    head = "SELECT key, parent, n, {} AS start, 1e300::DOUBLE AS ld, true AS live, "
    plain = [
        head.format(0) + ", ".join([*MEANS, *(f"s{i} * s{i} AS c{i}{i}" if i == j else f"0.0::DOUBLE AS c{i}{j}" for i, j in PAIRS)]),
        head.format(1) + ", ".join([*(f"m{i} + s{i} * d{i} AS m{i}" for i in range(D)), *(f"s{i} * s{j} * (p{i}{j} - d{i} * d{j}){plus(i, j)} AS c{i}{j}" for i, j in PAIRS)]),
        head.format(2) + ", ".join([*MEANS, *(f"s{i} * s{j} * {D} * u{i}{j}{plus(i, j)} AS c{i}{j}" for i, j in PAIRS)]),
    ]
    ctes = [
        _BASE,
        f"q0 AS (SELECT key, parent, f, CAST(round(v * 64) AS BIGINT) AS bin, count(*) AS n FROM ({long}) GROUP BY ALL)",
        "q1 AS (SELECT *, sum(n) OVER (PARTITION BY key, f ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY key, f) AS total FROM q0)",
        f"q2 AS (SELECT key, parent, f, max(total) AS n, {at(0.25)} AS lo, {at(0.5)} AS mid, {at(0.75)} AS hi FROM q1 GROUP BY ALL)",
        f"q3 AS MATERIALIZED (SELECT key, parent, max(n) AS n, {first} FROM q2 GROUP BY key, parent)",
        f"q4 AS MATERIALIZED (SELECT * FROM (SELECT key, {sums} FROM (SELECT *, {r} FROM (SELECT key, {z} FROM x JOIN q3 USING (key))) GROUP BY key) JOIN q3 USING (key))",
        "t0 AS MATERIALIZED (" + " UNION ALL ".join(f"{p} FROM q4" for p in plain) + ")",
    ]
    factor = SHARE / (1 - chi2_tail(chi2_point(1 - SHARE, D), D + 2))
    moments = [*(f"a{i}" for i in range(D)), *(f"p{i}{j}" for i, j in PAIRS)]
    cells = ", ".join([f"sum(x{i}) AS a{i}" for i in range(D)] + [f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in PAIRS])
    share = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (most - upto + k) / k))"
    means = ", ".join(f"a{i} / h AS m{i}" for i in range(D))
    cov = ", ".join(f"{factor!r}::DOUBLE * (p{i}{j} / h - m{i} * m{j}){plus(i, j)} AS c{i}{j}" for i, j in PAIRS)
    falls = f"coalesce(w.ld < t.ld - {FALL}::DOUBLE, false)"
    for s in range(STEPS):
        dist = f"SELECT key, start, x0, x1, x2, x3, {_distance()} FROM x JOIN (SELECT key, start, {_MEANS}, {_FACTOR} FROM ({_factored(f'SELECT * FROM t{s} WHERE live')})) USING (key)"
        ctes += [
            f"a{s} AS MATERIALIZED (SELECT *, sum(k) OVER (PARTITION BY key, start ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY key, start) * {SHARE}::DOUBLE AS most FROM (SELECT key, start, floor(16 * ln(0.001::DOUBLE + d2)) AS bin, count(*) AS k, {cells} FROM ({dist}) GROUP BY ALL))",
            f"b{s} AS (SELECT key, start, max(most) AS h, {', '.join(f'sum({share} * {c}) AS {c}' for c in moments)} FROM a{s} GROUP BY key, start)",
            f"w{s} AS MATERIALIZED (SELECT *, 2 * ({' + '.join(f'ln(l{i}{i})' for i in range(D))}) AS ld FROM ({_factored(f'SELECT *, {cov} FROM (SELECT *, {means} FROM b{s})')}))",
            f"t{s + 1} AS MATERIALIZED (SELECT t.key, t.parent, t.n, t.start, {', '.join(f'CASE WHEN {falls} THEN w.{c} ELSE t.{c} END AS {c}' for c in [*MEANS, *COVS, 'ld'])}, {falls} AS live FROM t{s} t LEFT JOIN w{s} w ON t.key = w.key AND t.start = w.start)",
        ]
    ctes += [
        f"best AS MATERIALIZED (SELECT * FROM t{STEPS} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ld, start) = 1)",
        f"o0 AS (SELECT parent AS key, {', '.join([*MEANS, *(f'{(WIDE * FLOORS[i]) ** 2!r}::DOUBLE AS c{i}{j}' if i == j else f'0.0::DOUBLE AS c{i}{j}' for i, j in PAIRS)])} FROM best WHERE key = 'a')",
        f"o1 AS MATERIALIZED ({_drawn('a', 'o0')})",
        f"o2 AS MATERIALIZED ({_drawn('l', 'o1')})",
        f"o3 AS MATERIALIZED ({_factored(_drawn('s', 'o2'))})",
        f"v AS (SELECT doc_id, {_distance()} FROM f JOIN o3 ON o3.key = f.ks)",
    ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {chi2_point(TAIL, D)!r}::DOUBLE, true) AS kept FROM b LEFT JOIN v USING (doc_id)"
