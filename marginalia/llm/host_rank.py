"""URL filter: rules by host and path, and verdicts by propagation over the graph of hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UNIT = 1_000_000  # mass of a host of which all pages are seeds
FOLLOW = 0.85  # share of a host's mass that goes on along its links
REST = 0.001  # share of the seeds' mass that may be left when propagation ends
ROUNDS = math.ceil(math.log(REST) / math.log(FOLLOW))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)<a[\t\n\f\r ][^>]*?\bhref[\t\n\f\r ]*=[\t\n\f\r ]*["']?[\t\n\f\r ]*((?:https?:)?//[^"'>\t\n\f\r ]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], give) -> Column:
    """``give(rule)`` of the longest rule that fits, else null; of two rules of one length that
    of the longer host. Rules are literals of the plan: a list of some hundred, not of millions."""
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
    return F.coalesce(*[F.when(fits(r), F.lit(give(r))) for r in longest], F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): pages of one host that link to another by an absolute address."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda u: host_of(F.concat(F.lit("x:"), F.regexp_replace(u, "(?i)^https?:", "")))))
    found = pages.select(F.col("host").alias("src"), F.explode(links).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def propagated(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, host, mass): personalised PageRank from ``seeds`` (kind, host, mass) over ``edges``
    (kind, src, dst, w), each kind for itself, as masses that visit a host, without the factor of a restart.

    Each round sends ``FOLLOW`` of what reached a host in the round before along its edges by
    weight, in whole units rounded down, so that sums don't depend on their order and rounds end
    when no unit is left, at latest when under ``REST`` of the seeds' mass is left. A round is a
    join and an aggregation on hosts, written to the shared folder; only a sum comes to the driver.
    """
    spark = seeds.sparkSession
    sums = edges.groupBy("kind", "src").agg(F.sum("w").alias("of"))
    shares = cut(edges.join(sums, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("of")).alias("share")), "host-edges")
    base = shared_path(spark, "host-mass")
    seeds.select("kind", "host", "mass").write.parquet(f"{base}/round=0")
    schema, k = "kind string, host string, mass double", 0
    while k < ROUNDS:
        last = spark.read.schema(schema).parquet(f"{base}/round={k}").withColumnRenamed("host", "src")
        sent = last.join(shares, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.floor(F.col("mass") * F.col("share") * F.lit(FOLLOW)).cast("double").alias("mass"))
        k += 1
        sent.where("mass > 0").groupBy("kind", "host").agg(F.sum("mass").alias("mass")).write.parquet(f"{base}/round={k}")
        if not spark.read.schema(schema).parquet(f"{base}/round={k}").agg(F.sum("mass")).first()[0]:
            break
    rounds = spark.read.schema(schema).parquet(*[f"{base}/round={i}" for i in range(k + 1)])
    return rounds.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def host_scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of hosts of ``pages`` (host, given, html): masses in units, of which
    a host whose pages are all allowed, or all blocked, by rule has ``UNIT`` of its own."""
    count = lambda v: F.count(F.when(F.col("given") == v, 1))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("allowed"), count("block").alias("blocked"))
    seed = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.floor(F.lit(float(UNIT)) * F.col(c) / F.col("n")).cast("double").alias("mass"))
    seeds = hosts.select("host", F.inline(F.array(seed("trust", "allowed"), seed("distrust", "blocked")))).where("mass > 0")
    edges = cut(host_edges(pages), "links")
    forth = edges.select(F.lit("trust").alias("kind"), "src", "dst", F.col("pages").alias("w"))
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("pages").alias("w"))
    mass = propagated(seeds, forth.union(back))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages`` (page_id, url, html).

    A page that a rule fits has that rule's verdict. Others have their host's: pages that rules
    allow are seeds of trust, which follows links from host to host; pages that rules block are
    seeds of distrust, which goes from a host to those that link to it. A host is blocked when its
    distrust exceeds its trust by more than half of what a wholly blocked host has of its own.

    Null and odd urls have an empty host, no seeds and the verdict allow. Null html has no links;
    only links of ``<a>`` elements to other hosts count, once a page and host. Repeated rows count
    as pages of their own. An empty table gives no rows; further columns have no part. A hot host is counted
    before the shuffle, and in the last join, on hosts, Spark splits its pages.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    given = parsed.select("*", by_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"), by_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("given"))
    scores = host_scores(given)
    bad = F.col("distrust") - F.col("trust") > UNIT / 2
    out = given.drop("html").join(scores, "host", "left").withColumn("verdict", F.coalesce("given", F.when(bad, "block"), F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", "verdict", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


_q = lambda s: "'" + s.replace("'", "''") + "'"
_LONGEST = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r))
_CASE = lambda give: "CASE " + " ".join(f"WHEN (host = {_q(h)} OR ends_with(host, {_q('.' + h)})) AND starts_with(path, {_q(p)}) THEN {_q(give((v, h, p)))}" for v, h, p in _LONGEST) + " END"
_HOST = f"translate(coalesce(regexp_extract({{0}}, {_q(_PARTS)}, 1), ''), '{_UPPER}', '{_LOWER}')"

#: DuckDB SQL of the op12 query: rules and the same rounds of propagation.
SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, html, {_HOST.format("url")} AS host, coalesce(regexp_extract(url, {_q(_PARTS)}, 2), '') AS path FROM pages),
g AS MATERIALIZED (SELECT *, {_CASE(lambda r: r[1] + r[2])} AS rule, {_CASE(lambda r: r[0])} AS given FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (given = 'allow') AS allowed, count(*) FILTER (given = 'block') AS blocked FROM g WHERE host <> '' GROUP BY host),
l AS (SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, {_q(_LINK)}, 1), lambda u: {_HOST.format("'x:' || regexp_replace(u, '(?i)^https?:', '')")}))) AS dst FROM g),
e AS (SELECT src, dst, count(*) AS w FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
k AS (SELECT 'trust' AS kind, src, dst, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e),
s AS MATERIALIZED (SELECT kind, src, dst, w::DOUBLE / sum(w) OVER (PARTITION BY kind, src) AS share FROM k),
r AS (SELECT 0 AS i, kind, host, mass FROM (SELECT 'trust' AS kind, host, floor({UNIT}.0::DOUBLE * allowed / n) AS mass FROM h UNION ALL SELECT 'distrust', host, floor({UNIT}.0::DOUBLE * blocked / n) FROM h) WHERE mass > 0
  UNION ALL SELECT i + 1, r.kind, dst, sum(floor(mass * share * {FOLLOW}::DOUBLE)) FROM r JOIN s ON s.kind = r.kind AND s.src = r.host WHERE i < {ROUNDS} AND floor(mass * share * {FOLLOW}::DOUBLE) > 0 GROUP BY i, r.kind, dst),
m AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM r GROUP BY host)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN distrust - trust > {UNIT / 2} THEN 'block' END, 'allow') AS verdict FROM g LEFT JOIN m USING (host)"""
