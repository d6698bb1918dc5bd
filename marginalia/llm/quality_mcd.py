"""Quality rules in DataFrame functions: text statistics, base rules, robust outliers.

Outliers are found by minimum-covariance-determinant estimates of location and scatter, one
per language and source: concentration steps over all rows of each group, from several starts,
until no determinant falls; the lowest is kept. An estimate is drawn towards that of the whole
language by as much as its group is small, so groups of every size are treated alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Standard deviations below which a feature's spread isn't trusted (clean groups have many zeros).
FLOORS = (0.04, 0.35, 0.05, 0.08)
D = len(FLOORS)
#: Share of a group that a concentration step keeps, and the fall of a log determinant below which
#: a start is done: steps go on until no start falls by more, however many they are. STEPS is what the
#: SQL of the query, which can't loop until then, unrolls.
SHARE, FALL, STEPS = 0.75, 0.02, 30
#: Rows that the estimate one level up counts for, and the spread above all levels, in floors.
PRIOR, WIDE = 40, 3
#: Chance that a row of a normal group lies beyond the cutoff.
TAIL = 1e-6
#: Groups up to which their estimates (some 200 bytes each) go to every task.
SMALL = 100_000


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, n: int = 8) -> Column:
    """How many words lie in an n-word window that the array holds twice or more.

    Windows are compared by 64-bit hashes. Only if some are equal, they are sorted with their
    places; each place covers the words up to the next one, n at most.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, h: F.coalesce(F.get(s, i)["h"] == h, F.lit(False))
        twice = bound(placed, lambda s: F.filter(s, lambda x, i: same(s, i - 1, x["h"]) | same(s, i + 1, x["h"])))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = bound(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(n), b - a)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    # each word is hashed once, then each window of n hashes
    hashed = bound(F.transform(words, lambda x: F.xxhash64(x)), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))
    found = bound(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > n, found).otherwise(F.lit(0)).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """Add the statistics of each whole ``text`` (null: no words) to the columns of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    words = F.array_remove(F.split(text, SPACE), "")
    both = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.withColumns({
        "words": both,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    both = F.col("words")
    out = out.withColumns({"n_words": both["n"], "n_repeat_words": both["r"]}).drop("words")
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return out.withColumn("base_failed", (n < 20) | (100 * r > 30 * n))


def features() -> list[Column]:
    """The transformed statistics: log mean word length, log symbol share, share of repeated
    words, log repeated lines; smoothed so that short texts don't stray by chance."""
    c = lambda x: F.col(x).cast("double")
    return [
        F.log((c("word_chars") + 100) / (c("n_words") + 20)),
        F.log(1 + 100 * c("n_symbols") / (c("word_chars") + 50)),
        c("n_repeat_words") / (c("n_words") + 50),
        F.log(1 + 20 * c("n_dup_lines") / (c("n_words") + 50)),
    ]


def _keys(lang: Column, source: Column) -> list[Column]:
    """Group keys from fine to coarse, the last is above all; a null language or source is a
    group of its own."""
    return [F.concat(F.lit("s"), F.to_json(F.struct(lang.alias("l"), source.alias("s")))), F.concat(F.lit("l"), F.to_json(F.struct(lang.alias("l")))), F.lit("a"), F.lit("")]


def chi2_tail(x: float, d: int) -> float:
    """P(chi-squared with an even number d of degrees > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_point(tail: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, d) > tail else (lo, mid)
    return lo


PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
MEANS, COVS = [f"m{i}" for i in range(D)], [f"c{i}{j}" for i, j in PAIRS]
FACTOR = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]
X = [f"x{i}" for i in range(D)]


def _factored(params: DataFrame) -> DataFrame:
    """Add the Cholesky factor l_ij of the covariance c_ij, column by column."""
    for j in range(D):
        own = F.col(f"c{j}{j}")
        for k in range(j):
            own = own - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        column = {f"l{j}{j}": F.sqrt(own)}
        for i in range(j + 1, D):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            column[f"l{i}{j}"] = rest / F.sqrt(own)
        params = params.withColumns(column)
    return params


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance by the row's m_i and l_ij: forward substitution."""
    z: list[Column] = []
    for i in range(D):
        rest = x[i] - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _few(groups: DataFrame, n: int) -> DataFrame:
    """A table with ``n`` rows, one or a few a group, to be joined to all rows: broadcast up to
    ``SMALL``, so that the rows of a large group stay where they are; beyond, Spark picks the join."""
    return F.broadcast(groups) if n <= SMALL else groups


def _medians(rows: DataFrame) -> DataFrame:
    """Median m_i and spread s_i of each feature from counts on a fixed grid: exact counts over
    all rows, the same for any partitioning."""
    grid = 64.0
    long = rows.select("key", "parent", F.posexplode(F.array(*X)).alias("f", "x"))
    counts = long.groupBy("key", "parent", "f", F.round(F.col("x") * grid).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = W.Window.partitionBy("key", "f")
    counts = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("total") * p, F.col("bin"))) / grid
    q = counts.groupBy("key", "parent", "f").agg(F.max("total").alias("n"), at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    spread = (F.col("hi") - F.col("lo")) / 1.349
    of = lambda i, c: F.max(F.when(F.col("f") == i, c))
    cols = [c for i in range(D) for c in (of(i, F.col("mid")).alias(f"m{i}"), F.sqrt(of(i, spread * spread) + FLOORS[i] ** 2).alias(f"s{i}"))]
    return q.groupBy("key", "parent").agg(F.max("n").alias("n"), *cols)


def _starts(rows: DataFrame, first: DataFrame, groups: int) -> DataFrame:
    """Three starts a group: medians and spreads; mean and covariance; medians and the
    covariance of signs, that is of rows drawn to one distance from the medians."""
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(D)]
    near = rows.select("key", *X).join(_few(first, groups), "key").withColumns({f"z{i}": v for i, v in enumerate(z)})
    near = near.withColumn("r", F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)) + 1e-9))
    z, u = [F.col(f"z{i}") for i in range(D)], [F.col(f"z{i}") / F.col("r") for i in range(D)]
    sums = [F.avg(z[i]).alias(f"d{i}") for i in range(D)] + [F.avg(z[i] * z[j]).alias(f"p{i}{j}") for i, j in PAIRS] + [F.avg(u[i] * u[j]).alias(f"u{i}{j}") for i, j in PAIRS]
    got = near.groupBy("key").agg(*sums).join(_few(first, groups), "key")
    m, s, d = ([F.col(f"{c}{i}") for i in range(D)] for c in "msd")
    floor = lambda i, j: FLOORS[i] ** 2 if i == j else 0.0
    plain = [F.struct(F.lit(0).alias("start"), *[m[i].alias(f"m{i}") for i in range(D)], *[(s[i] * s[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])]
    plain += [F.struct(F.lit(1).alias("start"), *[(m[i] + s[i] * d[i]).alias(f"m{i}") for i in range(D)], *[(s[i] * s[j] * (F.col(f"p{i}{j}") - d[i] * d[j]) + floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])]
    plain += [F.struct(F.lit(2).alias("start"), *[m[i].alias(f"m{i}") for i in range(D)], *[(s[i] * s[j] * D * F.col(f"u{i}{j}") + floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])]
    return got.select("key", "parent", "n", F.explode(F.array(*plain)).alias("p")).select("key", "parent", "n", "p.*").withColumns({"ld": F.lit(1e300), "live": F.lit(True)})


def _step(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """One concentration step of the live rows of ``params``: each group's ``SHARE`` of nearest
    rows, estimated anew. Where the log determinant ``ld`` doesn't fall by ``FALL``, the estimate
    stays and is no longer live.

    Rows are summed by log distance on a fixed grid; the cells below the cutoff count in full,
    the one that holds it by the share that is missing. So every start keeps equally many rows,
    ties and partitioning don't matter, and one shuffle of cells makes a step.
    """
    live = _factored(params.where("live")).select("key", "start", *MEANS, *FACTOR)
    near = rows.select("key", *X).join(_few(live, 3 * groups), "key").withColumn("bin", F.floor(16 * F.log(1e-3 + _distance([F.col(c) for c in X]))))
    x = [F.col(c) for c in X]
    cells = near.groupBy("key", "start", "bin").agg(F.count(F.lit(1)).alias("k"), *[F.sum(x[i]).alias(f"a{i}") for i in range(D)], *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in PAIRS])
    w = W.Window.partitionBy("key", "start")
    cells = cells.withColumns({"upto": F.sum("k").over(w.orderBy("bin")), "most": F.sum("k").over(w) * SHARE})
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("most") - F.col("upto") + F.col("k")) / F.col("k")))
    new = cells.groupBy("key", "start").agg(F.max("most").alias("h"), *[F.sum(share * F.col(c)).alias(c) for c in [*(f"a{i}" for i in range(D)), *(f"p{i}{j}" for i, j in PAIRS)]])
    new = new.select("key", "start", *[(F.col(f"a{i}") / F.col("h")).alias(f"m{i}") for i in range(D)], *[(F.col(f"p{i}{j}") / F.col("h")).alias(f"p{i}{j}") for i, j in PAIRS])
    point = chi2_point(1 - SHARE, D)
    factor = SHARE / (1 - chi2_tail(point, D + 2))  # makes the covariance of the nearest share that of all
    cov = {f"c{i}{j}": factor * (F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    new = _factored(new.withColumns(cov)).withColumn("ld", 2 * sum(F.log(f"l{i}{i}") for i in range(D)))
    new = new.select("key", "start", *[F.col(c).alias(f"new_{c}") for c in [*MEANS, *COVS, "ld"]])
    out = params.join(new, ["key", "start"], "left")
    falls = F.coalesce(F.col("new_ld") < F.col("ld") - FALL, F.lit(False))
    return out.select("key", "start", "parent", "n", *[F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in [*MEANS, *COVS, "ld"]], falls.alias("live"))


def _drawn(params: DataFrame, to: DataFrame) -> DataFrame:
    """Estimates drawn towards those of their parents, which count for ``PRIOR`` rows: location
    and scatter of the mixture of both."""
    to = to.select(F.col("key").alias("parent"), *[F.col(c).alias(f"to_{c}") for c in [*MEANS, *COVS]])
    w = F.col("n") / (F.col("n") + PRIOR)
    m = {f"m{i}": w * F.col(f"m{i}") + (1 - w) * F.col(f"to_m{i}") for i in range(D)}
    apart = [F.col(f"m{i}") - F.col(f"to_m{i}") for i in range(D)]
    c = {f"c{i}{j}": w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"to_c{i}{j}") + w * (1 - w) * apart[i] * apart[j] for i, j in PAIRS}
    return params.join(to, "parent").withColumns(m | c).select("key", "parent", "n", *MEANS, *COVS)


def fit(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, int]:
    """Robust location and scatter (key, n, m_i, l_ij) of every language and source over the
    rows that pass the base rules, and their number."""
    keys = _keys(F.col(lang_col), F.col(source_col))
    levels = F.array(*[F.struct(k.alias("key"), p.alias("parent")) for k, p in zip(keys, keys[1:])])
    rows = stats.where(~F.col("base_failed")).select(F.explode(levels).alias("k"), *[f.alias(c) for f, c in zip(features(), X)]).select("k.*", *X)
    rows = cut(rows, "mcd-rows")
    first = cut(_medians(rows), "mcd-medians")
    groups = first.count()
    params = cut(_starts(rows, first, groups), "mcd-starts")
    live = True
    while live:  # ends: each step lowers a determinant that the floors bound from below
        params = cut(_step(rows, params, groups), "mcd-step")
        live = params.where("live").limit(1).count() > 0
    best = params.withColumn("place", F.row_number().over(W.Window.partitionBy("key").orderBy("ld", "start"))).where("place = 1")
    level = lambda c: best.where(F.substring("key", 1, 1) == c)
    wide = {f"c{i}{j}": F.lit((WIDE * FLOORS[i]) ** 2 if i == j else 0.0) for i, j in PAIRS}
    top = level("a").withColumn("key", F.col("parent")).withColumns(wide)
    drawn = _drawn(level("s"), _drawn(level("l"), _drawn(level("a"), top)))
    return cut(_factored(drawn).select("key", "n", *MEANS, *FACTOR), "mcd-params"), groups


def verdict(stats: DataFrame, params: DataFrame, groups: int, lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Add ``distance`` and ``kept``: rejected are base failures and rows whose squared distance
    by their group's estimate is beyond the chi-squared point of ``tail``."""
    keyed = stats.withColumn("key", _keys(F.col(lang_col), F.col(source_col))[0])
    far = _distance(features())
    out = keyed.join(_few(params.drop("n"), groups), "key", "left").withColumn("distance", far)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_point(tail, D), F.lit(True))).drop("key", *MEANS, *FACTOR)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics, base verdict and final verdict of every document.

    Null text: no words, so the base rules reject it. Null language or source: a group of its
    own. Repeated rows and null ids are judged each, equal rows alike. An empty table gives an
    empty result. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = cut(text_stats(rows).drop("text"), "quality-stats")
    return verdict(stats, *fit(stats)).select("doc_id", *BASE, "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names; edge
    cases as for ``quality``. Documents and statistics are written once and judged from there."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = cut(text_stats(rows).drop("text"), "quality-stats")
    return verdict(stats, *fit(stats)).where("kept").select("row.*")
