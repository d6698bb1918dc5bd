"""Prefix trie, host graph and Merkle manifest against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import host_rank, merkle, turn_trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------- conversations


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, t in convs.items():
        t.sort(key=lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()[:16]))
        convs[c] = [x[2:] for x in t]
    whole = {}
    for c, t in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = convs.get(int(c / 20) * 20, [])[:h] + t[h:]
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def down(p):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [down(k) for k in kids.get(p, [])]
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out[(min(members[p]), len(p))] = (min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, sha(ends))
        return leaves, saved

    if whole:
        down(())
    return out


def trie_of(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts or before)
    try:
        got = turn_trie.trie(df.withColumn("KEY", F.lit(1)).withColumn("upto", F.lit(2))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = {(r[0], r[1]): tuple(r[2:]) for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("seed,parts", [(1, "3"), (2, "7"), (3, "70")])
def test_trie(spark, seed, parts):
    """Few different turns, so that prefixes branch at every depth and copies cross partitions;
    70 partitions take two rounds of merging."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 300), 120):
        kind = rng.random()
        n = 0 if kind < 0.1 else rng.randrange(1, 9)
        for t in range(n):
            word = "same" if kind < 0.4 else rng.choice(["a b", "a", "", None, "x  y\tz", "é"])
            rows.append((c, rng.choice([t, t, None]) if kind > 0.9 else t, rng.choice(["user", None]) if kind > 0.8 else "user", word))
        if n and kind > 0.95:
            rows.append(rows[-1])
    rows += [(500 + 20 * i, t, "user", "copy") for i in range(40) for t in range(3)]
    assert trie_of(spark, rows, parts) == brute_trie(rows)


def test_trie_odd_rows(spark):
    assert trie_of(spark, []) == {}
    assert trie_of(spark, [(None, 0, "user", "x")]) == {}
    alone = [(3, 0, None, None)]
    assert trie_of(spark, alone) == brute_trie(alone)
    # one conversation of 2,000 turns and a copy of it that ends earlier
    long = [(40, t, "user", f"w{t} v") for t in range(2000)] + [(60, t, "user", f"w{t} v") for t in range(1500)]
    got = trie_of(spark, long)
    assert len(got) == 2001 and got[(40, 1500)][1:3] == (2, 1) and got[(40, 0)][4] == 3000


def test_forest_waits_at_open_ends():
    """Contracted items number at most two for each depth, whatever the number of rows."""
    rng = random.Random(4)
    depths = [rng.randrange(5) for _ in range(999)]
    items = [(1, i, 0, 0, 6, 0, i) for i in range(1000)]
    nodes, left, edges = turn_trie.Forest(items, [(d, d) for d in depths], False).merge()
    assert len(left) <= 11 and len(edges) == len(left) - 1 and sum(x[0] for x in left) == 1000
    nodes, left, edges = turn_trie.Forest(items, [(d, d) for d in depths], True).merge()
    assert len(left) == 1 and not edges and nodes[-1][0] == 1000 and nodes[-1][7] == -1


# ---------- urls


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    rows = [
        (1, "http://a.example.com/en/1?x", ""), (2, "http://WWW.Example.COM/en/", ""), (3, "https://x.net/es/q#t", ""), (4, "http://com/", ""), (5, "http://com", ""), (6, None, None),
        (7, "no scheme", ""), (8, "http://notcom/x", ""), (9, "http://b.www.example.com/en/z", ""), (10, "x://y://z.net/fr/", ""), (11, "http://x.net/fr", ""), (11, "http://x.net/fr", ""),
    ]
    got = [tuple(r)[1:] for r in host_rank.judged(pages_of(spark, rows).withColumn("host", F.lit("x"))).drop("trust", "distrust").orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/es/q", "net/es/", "block"), ("com", "/", "com/", "allow"),
        ("com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notcom", "/x", None, "allow"), ("b.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        ("y:", "//z.net/fr/", None, "allow"), ("x.net", "/fr", None, "allow"), ("x.net", "/fr", None, "allow"),
    ]
    assert host_rank.judged(pages_of(spark, [])).count() == 0


def graph_pages(seed):
    rng = random.Random(seed)
    hosts = [f"h{i}.org" for i in range(30)] + [f"t{i}.com" for i in range(5)] + [f"b{i}.net" for i in range(6)]
    rows, k = [], 0
    for h in hosts:
        for _ in range(rng.randrange(1, 6)):
            path = rng.choice(["/es/1", "/fr/2"]) if h.endswith(".net") else "/x"
            links = "".join(f"<a class=q href={rng.choice(['', chr(34)])}{rng.choice(['http://', 'https://', '//', 'HTTP://'])}{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}/p?q>t</a>" for _ in range(rng.randrange(4)))
            rows.append((k, f"http://{h}{path}", f"<html>{links}<a href='/own'>o</a><link href='http://h1.org/'></html>"))
            k += 1
    return rows


def brute_scores(rows):
    from collections import Counter, defaultdict
    from math import floor

    pages, given, edges = Counter(), defaultdict(Counter), Counter()
    for _, url, html in rows:
        host, path = re.match(r".*?://([^/]*)(.*)", url).groups()
        pages[host] += 1
        given[host]["trust" if host.endswith(".com") else "distrust" if host.endswith(".net") and path[:4] in ("/es/", "/fr/") else "-"] += 1
        for dst in {m.lower() for m in re.findall(r'(?i)<a class=q href="?(?:https?:)?//([^/"]*)', html)} - {host}:
            edges[host, dst] += 1
    score = {}
    for kind in ("trust", "distrust"):
        flow = {e if kind == "trust" else e[::-1]: n for e, n in edges.items()}
        out = Counter()
        for (u, _), n in flow.items():
            out[u] += n
        mass = {h: float(floor(1e6 * given[h][kind] / pages[h])) for h in pages if given[h][kind]}
        total = Counter(mass)
        for _ in range(host_rank.ROUNDS):
            new = Counter()
            for (u, v), n in flow.items():
                if u in mass:
                    new[v] += floor(mass[u] * (n / out[u]) * 0.85)
            mass = {h: float(m) for h, m in new.items() if m > 0}
            total.update(mass)
        for h, m in total.items():
            score.setdefault(h, {})[kind] = m
    return score


@pytest.mark.parametrize("seed", [5, 6])
def test_propagation(spark, seed):
    rows = graph_pages(seed)
    want = brute_scores(rows)
    got = host_rank.judged(pages_of(spark, rows)).collect()
    verdicts = set()
    for r in got:
        s = want.get(r["host"], {})
        assert (r["trust"], r["distrust"]) == (s.get("trust", 0.0), s.get("distrust", 0.0)), r["host"]
        if r["rule"] is None:
            bad = s.get("distrust", 0) - s.get("trust", 0) > 500_000
            verdicts.add(r["verdict"])
            assert r["verdict"] == ("block" if bad else "allow")
    assert verdicts == {"allow", "block"}


def test_propagation_equals_sql(spark):
    import duckdb

    rows = graph_pages(7)
    con = duckdb.connect()
    import pandas as pd

    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con.register("pages", pages)
    want = sorted(con.execute(host_rank.SQL).fetchall())
    got = sorted(tuple(r) for r in host_rank.judged(pages_of(spark, rows)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want


def test_filter_is_native(spark):
    plan = host_rank.judged(pages_of(spark, graph_pages(8)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---------- manifests


def brute_manifest(rows):
    def f(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    groups, out = {}, {}
    for r in rows:
        t = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and t is not None:
            t = t.replace("\n", "")
        groups.setdefault(r[1], []).append((r[0], sha("".join(map(f, r))), sha("".join(map(f, (*r[:4], t))))))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append([sha("".join(x[i : i + 3])) for i in range(0, len(x), 3)])
        return levels

    def path(levels, i):
        p = []
        for x in levels[:-1]:
            s = i - i % 3
            p.append(("".join(x[s:i]), "".join(x[i + 1 : s + 3])))
            i //= 3
        return p

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    found = []
    for g, s in enumerate(names):
        for i, (doc, leaf, other) in enumerate(groups[s]):
            p = path(trees[s], i) + path(top, g)
            h = other
            for left, right in p:
                h = sha(left + h + right)
            found.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in p)), h, h == top[-1][0]))
    return found


@pytest.mark.parametrize("sizes", [[1], [1, 1, 3, 4], [2, 243, 244, 729, 1, 9]])
def test_manifest(spark, sizes, monkeypatch):
    from marginalia.llm import entry

    rng, rows, k = random.Random(9), [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            k += rng.randrange(1, 3)
            rows.append((k, None if g == 0 else f"sö{g}", rng.choice(["de", None]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "é\n", "x" * 50])))
    if len(rows) > 1:
        rows += [rows[-1], (None, "sö1", None, None, "n\nn"), (None, "sö1", "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("LEAF", F.lit(1)).withColumn("name", F.lit("x"))
    monkeypatch.setattr(entry, "table", lambda *a: docs)
    got = [tuple(r) for r in entry.op13_merkle(spark, "").collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(brute_manifest(rows), key=order)


def test_manifest_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).count() == 0


def test_manifest_proof_is_text(spark):
    """Left and right of each step hold whole digests, two at most."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    for r in merkle.manifest(docs).collect():
        assert len(r["path"]) == 6 and all((len(a) + len(b)) in (0, 64, 128) for a, b in r["path"])
