"""The training-data operators against brute force, libraries and edge cases."""

import base64
import gzip
import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, byte_bpe, lang_bigru, packing, partenum, pivot_topk, quality_mcd, template_extract, token_counts, toxicity_ssk, warc_index
from marginalia.llm import entry as llm
from marginalia.llm.common import table
from marginalia.llm.components import components

RANKS, JSON, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "a", "  two  spaces\n\n and lines ", "é" * 50, "x" * 3000, "<|endoftext|> in <|startoftext|> text", "don't 1234 'll", "tab\there \x1c odd", "日本語 の テキスト", "!!??..", "a b c d e f g h " * 40]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    names = "n score words part bin key n_words kept a b z sig class_id component_id __id __toxic __gone gone __q_kept __q_n_words row x0 template host number".split()
    return df.select("*", *[F.lit("clash").alias(x) for x in names]) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = c.execute(llm.SQL[name])
    at = [[d[0] for d in cursor.description].index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


# 1
def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://A.example.com/b?q=1#f", big), (5, "https://a.example.com:8080/", big), (3, None, big), (4, "bad url [", "short"), (6, "http://z.example.com", "short"), (7, "http://a.example.com/b", None), (8, "", ""), (5, "https://a.example.com:8080/", big), (None, "http://n.example.com", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).withColumn("n", F.lit(1))
    got = warc_index.capture_index(pages, path=str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    kind = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kind[(1, "revisit", 5)] == kind[(3, "revisit", 5)] == 1 and kind[(5, "response", None)] == 2 and kind[(None, "response", None)] == 1
    for r in got:
        text = next((h for i, _, h in rows if i == r["page_id"]), "") or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
    order = [(r["url_key"], r["captured"]) for r in sorted(got, key=lambda r: (r["shard"], r["shard_pos"]))]
    assert order == sorted(order)
    archives = [gzip.open(f).read() for f in (tmp_path / "w").glob("*/*.gz")]
    assert sum(a.count(b"WARC-Record-ID") for a in archives) == len(rows) and all(a.startswith(b"WARC/1.1\r\n") for a in archives if a)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_index.capture_index(none).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc_index.loser_tree([iter(r) for r in runs], lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc_index.url_key("HTTP://www.A.com:80/x?y#z") == "com,a)/x?y" and warc_index.url_key(None) == "" and warc_index.url_key("http://[bad") == "http://[bad"


# 2
def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)] + [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (401, [float("inf")] * 4), (450, [0.5, 0.5])]
    rows += [(50, rows[50][1]), (10, rows[10][1])]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in pivot_topk.top_k(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    for q in {i for i, _ in ok if i % 50 == 0}:
        v = next(x for i, x in ok if i == q)
        every = sorted(((i, int(v @ x)) for i, x in ok if i != q and len(x) == len(v)), key=lambda t: (-t[1], t[0]))
        assert got.get(q, []) == every[:5]
    assert pivot_topk.top_k(df.limit(0)).count() == 0


def test_elimination_on_clusters(spark, monkeypatch):
    """On clustered vectors most candidates are never evaluated, and the result is exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 4
    centres *= 12 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + rng.normal(size=(150, 16)) * 0.05 for c in centres])
    whole = np.floor(256 * x)
    pivots = pivot_topk.farthest_first(whole, pivot_topk.PIVOTS)
    far = pivot_topk.pivot_distances(whole, pivots)
    q = np.arange(0, len(x), 50)
    least = np.sort(whole[q] @ whole.T, 1)[:, -6]
    seen = pivot_topk.block_topk(q, whole[q], far[q], np.arange(len(x)), whole, far, 5, least)[1]
    assert seen < 0.1 * len(q) * len(x)
    monkeypatch.setattr(pivot_topk, "CANDIDATES", 200)
    monkeypatch.setattr(pivot_topk, "QUERIES", 7)
    got = defaultdict(list)
    for r in pivot_topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in q:
        every = sorted(((j, int(s)) for j, s in enumerate(whole @ whole[i]) if j != i), key=lambda z: (-z[1], z[0]))
        assert got[i] == every[:5]


def test_bounds_stop_early():
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.normal(size=(40, 8)) * 200, rng.normal(size=(2000, 8)) * 5]))
    pivots = pivot_topk.farthest_first(x, 16)
    far = pivot_topk.pivot_distances(x, pivots)
    found, seen = pivot_topk.block_topk(np.arange(5), x[:5], far[:5], np.arange(len(x)), x, far, 5)
    assert seen < 5 * len(x)
    for i, ids, scores in found:
        s = x @ x[i]
        s[i] = -np.inf
        assert scores.tolist() == sorted(s, reverse=True)[:5]


# 3
def test_token_counts(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(60).collect()] + ODD
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts), JSON, chunk=400, overlap=140, huge=1000).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 512)
    assert token_counts.token_counts(empty(spark), JSON).count() == 0


def test_splice(sf, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    rng = random.Random(5)
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(25).collect()]
    texts += ["".join(rng.choice("ab '<|endoftext|>\n  é1,") for _ in range(3000)), "y" * 4000, " ".join(["<|endoftext|>"] * 300), ("word " * 300 + "z" * 900) * 2]
    for x in texts:
        for chunk, overlap in ((300, 130), (500, 200)):
            assert token_counts.splice_ids(x, t, chunk, overlap) == t.encode(x, add_special_tokens=False).ids


# 4
PAGE = """<html><head><title>T {i}</title><style>p {{}}</style></head><body><header><a href=/>Site {i}</a></header><nav class=m><ul><li><a>Home {i}</a><li><a>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div>{main}<aside><p>More {i}</p></aside><section id="comments"><p>Nice {i}</p></section><form><p>Join</p></form><script>var a = "<p>no</p>";</script><footer>&copy; {i}</footer></body></html>"""


def test_template_text(spark):
    rows = []
    for i in range(12):
        body = f"<h1>Head {i}</h1><p>One &amp; <b>two</b>\n  {i}<p>Three<br>four &lt;{i}&gt;</p>"
        rows.append((i, f"http://one.example.com/{i}", PAGE.format(i=i, main=f"<article>{body}</article>")))
        rows.append((100 + i, f"http://two.example.com/{i}", PAGE.format(i=i, main=f"<div class=content>{body}{'<p>' + f'long text {i} ' * 20 + '</p>'}<p>Read on</p></div>")))
    rows += [(500, None, None), (501, "x", ""), (502, "http://one.example.com/x", "<p>only"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("z", F.lit("clash"))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in template_extract.main_text(pages).collect())
    want = "Head {0}\nOne & two {0}\nThree four <{0}>"
    for i in range(12):
        t = want.format(i)
        assert got[(i, t, len(t))] == (2 if i == 0 else 1)
        long = t + "\n" + (f"long text {i} " * 20).strip()  # what every page repeats is the template's
        assert got[(100 + i, long, len(long))] == 1
    assert got[(500, "", 0)] == got[(501, "", 0)] == 1 and sum(got.values()) == len(rows)
    assert template_extract.main_text(pages.limit(0)).count() == 0


def test_template_on_pages(spark, sf):
    def plain(x):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", x, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(p for p in parts if p)

    source = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in llm.op4_template_text(spark, sf).collect()}
    assert got == {i: plain(x) for i, x in source.items()}


@pytest.mark.parametrize("shape", ["<div class=x9>{}</div>", "<article>{}<div class=comments><p>Nice {i}</p></div></article>", "<table><tr><td>{}</td></tr></table>"])
def test_template_alone(shape):
    """The main element is found by what varies between pages, without any name."""
    rng = random.Random(1)
    pages, want = [], []
    for i in range(30):
        ps = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(2, 6))]
        body = shape.replace("{i}", str(i)).replace("{}", "".join(f"<p>{p}</p>" for p in ps))
        pages.append(f"<html><body><div class=q1><a href=/>Home</a><a href=/n>News {i % 3}</a></div><div class=q2>Text of the day {i % 4}</div>{body}<div class=q3>All rights {i % 2}</div></body></html>")
        want.append("\n".join(ps))
    if "comments" in shape:
        assert template_extract.extract(pages) == want
    else:
        assert template_extract.extract(pages, labels=False) == want


def test_template_of_given_pages(spark, sf):
    """Without names the template alone finds nearly all articles of the table."""
    rows = [(r["url"], r["html"]) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    hosts = defaultdict(list)
    for url, x in rows:
        hosts[re.match(r"[a-z]*://([^/]*)", url or "x://")[1]].append(x)
    same = [a == b for xs in hosts.values() for a, b in zip(template_extract.extract(xs, labels=False), template_extract.extract(xs))]
    assert len(same) == len(rows) and np.mean(same) >= 0.99


def test_classes():
    paths = template_extract.Paths()
    pages = [template_extract.parse(f"<div><p>{'<i>x</i>' * (i + 1)}</p><ul>{'<li>a</li>' * 2}</ul></div>", paths) for i in range(4)]
    classes = template_extract.equivalence_classes(pages)
    root = template_extract.skeleton(pages, classes)
    assert (0, "<div") in root and len(template_extract.nested(pages, classes, root)) > 0


# 5
def test_gradients():
    rng = np.random.default_rng(0)
    net = lang_bigru.Network(["a", "b", "c"], 3)
    x, lens, label = rng.integers(0, 256, (5, 4)), np.array([5, 3, 1, 5]), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, lens, label)
    for w, g in zip(net.weights(), grads):
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in w.shape)
            i = (i[0], x[0, rng.integers(4)]) if w.shape[-1] == 256 else i
            old = w[i]
            w[i] = old + 1e-5
            up = net.gradients(x, lens, label)[0]
            w[i] = old - 1e-5
            down = net.gradients(x, lens, label)[0]
            w[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_languages(spark, sf):
    df = table(spark, sf, "documents")
    lang = {r["doc_id"]: r["lang"] for r in df.collect()}
    got = llm.op5_language(spark, sf).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    apart = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in apart]) >= 0.95


def test_language_edges(spark):
    got = {r["doc_id"]: r for r in lang_bigru.languages(frame(spark, ODD)).collect()}
    assert len(got) == len(ODD) and all(got[i]["lang_pred"] == "und" for i in (0, 1, 2, 11)) and got[3]["lang_pred"] == "en"
    assert lang_bigru.languages(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in lang_bigru.languages(frame(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_labels_equal_the_slow_recurrence():
    """Segments with warm-up give the probabilities of the network run over the whole text."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["der", "the", "les", "und", "ß", "é"]) for _ in range(n)) for n in (1, 30, 150, 500, 900)]
    net = lang_bigru.train([[t.encode()[i : i + 64] for i in range(0, 600, 64)] for t in texts[3:]], ["de", "en"], steps=20)
    got = net.frozen().documents(texts)
    for text, p in zip(texts, got):
        x = np.frombuffer(text.encode(), np.uint8)[:, None].astype(int)
        there, back = net.there.forward(x, np.ones(x.shape)), net.back.forward(x[::-1], np.ones(x.shape))
        h = np.stack([np.concatenate([there[i][5], back[len(x) - 1 - i][5]]) for i in range(len(x))], 1)[:, :, 0]
        z = np.exp(net.v @ h + net.c)
        assert np.abs((z / z.sum(0)).mean(1) - p).max() < 2e-3


# 6
def brute(rows, n, num, den):
    sets, up = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_random(spark, n, num, den):
    rng = random.Random(n)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    shared = [f"s{i}" for i in range(50)]
    texts = list(ODD)
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(shared + w if rng.random() < 0.3 else w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_groups(frame(spark, texts), n, num, den).collect()}
    assert got == brute(list(enumerate(texts)), n, num, den)


def test_signatures_share():
    """Sets within the threshold always share a signature, also where parts are empty."""
    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (8, 10), (1, 2)):
        make = partenum.Signatures(num, den)
        for size in (6, 7, 9, 14, 30, 80, 300):
            for _ in range(30):
                a = np.unique(rng.integers(1, 2**62, size, dtype=np.uint64))
                cut = int(len(a) * (den - num) / (den + num))
                b = np.unique(np.concatenate([a[cut:], rng.integers(1, 2**62, cut, dtype=np.uint64)]))
                same = len(np.intersect1d(a, b))
                if den * same >= num * (len(a) + len(b) - same) and not np.array_equal(a, b):
                    at, sig = make.of([a, b])
                    assert set(sig[at == 0].tolist()) & set(sig[at == 1].tolist())


def test_residual_buckets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1, 2**62, 50, dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(1, 2**62, 2, dtype=np.uint64)])) for s in sets[:10]]
    ids = np.arange(len(sets))
    sketches = [partenum.parity_sketch(s) for s in sets]
    likely = set(partenum.likely_pairs(ids, ids, np.array([len(s) for s in sets]), sketches, 85, 100))
    for a in range(len(sets)):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b]))
            if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                assert (b, a) in likely
    assert len(likely) < 60


def test_sketches_bound_the_difference():
    """Sketches never differ in more bits than the sets in members, at any two widths."""
    rng = np.random.default_rng(6)
    for size in (1, 5, 33, 100, 700):
        for change in (0, 1, size // 2, 3 * size):
            a = np.unique(rng.integers(1, 2**62, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[change // 2 :], rng.integers(1, 2**62, change, dtype=np.uint64)]))
            x, y = partenum.parity_sketch(a), partenum.parity_sketch(b)
            assert partenum.differing(x, y) == partenum.differing(y, x) <= len(np.setxor1d(a, b))
            rows = [partenum.fold(np.frombuffer(z, np.uint8)[None], min(len(x), len(y))) for z in (x, y)]
            assert int(np.bitwise_count(rows[0] ^ rows[1]).sum()) == partenum.differing(x, y)


def test_jaccard_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, None), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in partenum.jaccard_groups(df).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (None, 1): 1, (None, None): 2, (3, 3): 1, (4, 4): 1}
    left = partenum.one_of_each(df.withColumn("n", F.lit("clash")))
    assert left.columns == ["doc_id", "text", "n"] and Counter(r["doc_id"] for r in left.collect()) == {1: 1, None: 3, 3: 1, 4: 1}
    assert partenum.jaccard_groups(empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 4), (20, 12), (12, 11)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 10, **{100 + i: 100 for i in range(31)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7
def base_stats(text):
    space = r"[\x20\x09-\x0D]"
    w = [x for x in re.split(space + "+", text or "") if x]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.sub(space, "", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality(spark, sf):
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(120).collect()] + ODD + ["l m\nl m\n \n \nl m", "# * $ % & | < >"]
    got = {r["doc_id"]: r for r in quality_mcd.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_stats(t)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_mcd.quality(empty(spark)).count() == 0
    kept = quality_mcd.keep_good(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_outliers(spark):
    """Planted junk goes, clean rows stay, in a group that a third of junk contaminates little."""
    rng = random.Random(0)
    words = ["".join(rng.choice("etaoins") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randrange(40, 400))) for _ in range(400)]
    junk = [" ".join(rng.choice(words) + "%%%" for _ in range(80)) for _ in range(30)]
    df = frame(spark, clean + junk).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r["kept"] for r in quality_mcd.quality(df).collect()}
    assert all(got[i] for i in range(400)) and not any(got[i] for i in range(400, 430))


def test_mcd_matches_numpy(spark):
    """The determinant is as low as the best of many random starts of an own numpy version, and
    what that calls outlying is what the query rejects."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, [0.1, 0.8, 0.1, 0.2], (500, 4)), rng.normal([0.8, 4, 0.8, 1], 0.2, (90, 4))])
    rows = spark.createDataFrame([("a", "", *map(float, r)) for r in x], "key string, parent string, x0 double, x1 double, x2 double, x3 double").cache()
    params = quality_mcd._starts(rows, quality_mcd._medians(rows), 1)
    for _ in range(quality_mcd.STEPS):
        params = quality_mcd.cut(quality_mcd._step(rows, params, 1), "test-step")
        if not params.where("live").count():
            break
    floor, h = np.diag(np.array(quality_mcd.FLOORS) ** 2), round(quality_mcd.SHARE * len(x))
    factor = quality_mcd.SHARE / (1 - quality_mcd.chi2_tail(quality_mcd.chi2_point(1 - quality_mcd.SHARE, 4), 6))
    best = (np.inf, None, None)
    for _ in range(60):
        at = rng.choice(len(x), 6, False)
        for _ in range(30):
            m, c = x[at].mean(0), factor * np.cov(x[at].T, bias=True) + floor
            at = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:h]
        best = min(best, (np.linalg.slogdet(c)[1], m.tolist(), c.tolist()))
    got = params.orderBy("ld").first().asDict()
    assert got["ld"] < best[0] + 0.1
    assert np.allclose([got[f"m{i}"] for i in range(4)], best[1], atol=0.05)
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    assert ((d > quality_mcd.chi2_point(quality_mcd.TAIL, 4)) == (np.arange(len(x)) >= 500)).all()


def test_small_groups(spark):
    """A source of few documents is judged by its own estimate as far as it goes: what is usual
    there stays, also where the language has nothing like it."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoins") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(300)]
    marked = [" ".join(rng.choice(words) + ("%" if rng.random() < 0.6 else "") for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    rows = [(i, t, "en", "small" if i >= 300 else "large", 1) for i, t in enumerate(plain + marked)] + [(900 + i, t, "en", "large", 1) for i, t in enumerate(marked[:5])]
    got = {r["doc_id"]: r["kept"] for r in quality_mcd.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(360)) and not any(got[900 + i] for i in range(5))


# 8
def test_packing(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(60).collect()] + ODD + ODD
    size = 256
    rows = packing.packed(frame(spark, texts).repartition(3), WORDS, size=size).collect()
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, want in enumerate(ids):
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            assert (r["continued"], r["continues"]) == (at > 0, at + r["length"] < len(want))
            at += r["length"]
        assert at == len(want)
    assert sorted(seqs) == list(range(len(seqs)))
    for k, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or k == len(seqs) - 1
    assert packing.packed(empty(spark), WORDS).count() == 0


# 9
def test_kernel():
    def slow(s, t, n, d):
        from itertools import combinations

        total = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if [s[i] for i in a] == [t[i] for i in b]:
                    total += d ** (a[-1] - a[0] + b[-1] - b[0] + 2)
        return total

    words = ["idiot", "idxiot", "clown", "abcd", "aaaaaa", "ab", "cxlxoxwn", "tidiotic"]
    exact = lambda s, t: slow(s, t, toxicity_ssk.LENGTH, float(toxicity_ssk.DAMP))
    marks = [w for w in words if len(w) >= toxicity_ssk.LENGTH]
    values = toxicity_ssk.Landmarks(marks).dense(words)
    for i, s in enumerate(words):
        for j, t in enumerate(marks):
            k = toxicity_ssk.kernel(toxicity_ssk.codes([s], len(s)), toxicity_ssk.codes([t], 9))[0]
            assert abs(k - exact(s, t)) < 1e-4 * max(1, k)
            norm = np.sqrt(exact(s, s) * exact(t, t))
            assert abs(values[i, j] - (exact(s, t) / norm if norm else 0)) < 1e-4
    # landmarks of three letters by subsequences of three, two letters by equality, each apart from the others
    mixed = toxicity_ssk.Landmarks(["idiot", "ass", "xy"])
    read = ["a.ss", "ass", "axss", "axsxs", "idiot", "as", "xy", "xya"]
    got = mixed.dense(read)
    short = lambda s, t: slow(s, t, 3, float(toxicity_ssk.DAMP))
    for i, s in enumerate(read):
        want = short(s, "ass") / np.sqrt(short(s, s) * short("ass", "ass")) if len(s) > 2 and short(s, s) else 0
        assert abs(got[i, 1] - want) < 1e-4 and got[i, 2] == (s == "xy")
    assert got[1, 1] > got[2, 1] > got[3, 1] > 0.1


def test_toxicity_features():
    """Totals and features against sums word by word, over blocks and texts of any length."""
    rng = random.Random(4)
    marks = toxicity_ssk.Landmarks(["idiot", "moron", "ass", "pathetic"])
    machine = toxicity_ssk.Machine(marks)
    machine.usual, machine.gapped = np.array([0.1, 0.0, 0.2, 0.3]), np.array([0.35, 0.3, 0.4, 0.6])
    words = ["idiot", "idxiot", "mornings", "mo", "pathetically", "axss", "thetic", "q"]
    texts = [[], ["idiot"], [rng.choice(words) for _ in range(60_000)], ["q"], [rng.choice(words) for _ in range(9)]]
    n, sums, best = machine.totals(texts, toxicity_ssk.Words(marks))
    x = machine.features(n, sums, best)
    k = dict(zip(words, marks.dense(words)))
    ramp = lambda v: np.clip((v - machine.usual) / (machine.gapped - machine.usual), 0, 1)
    for i, ws in enumerate(texts):
        rows = np.array([k[w] for w in ws]).reshape(-1, 4)
        found = [rows.sum(0), (rows**2).sum(0), np.array([ramp(v) for v in rows]).reshape(-1, 4).sum(0)]
        near = rows.max(0) if ws else np.zeros(4)
        want = [near]
        for total, w in zip(found, (*(toxicity_ssk.NYSTROM * w for w in marks.whiten), np.eye(4))):
            want += [np.log1p(total) @ w, np.log1p(200 * total / (len(ws) + 50)) @ w]
        assert np.allclose(x[i], np.concatenate([*want, [1.0]]), rtol=1e-3, atol=1e-3)
    for p, w in zip(toxicity_ssk.POWERS, marks.whiten):  # Nyström: the features' products are the kernel of landmarks
        km = marks.dense(marks.words) ** p
        km[[0, 1, 3], 2] = km[2, [0, 1, 3]] = 0
        assert np.allclose((km @ w) @ (km @ w).T, km, atol=0.02)


def test_toxicity_words_kept():
    """100,000 words are compared once, whatever marks stand at their edges, and are still known in the next batch."""
    machine = toxicity_ssk.Machine(toxicity_ssk.Landmarks([f"{a}{b}idiot" for a in "abcdefgh" for b in "ijklmnop"]))
    kept, compared = toxicity_ssk.Words(machine.landmarks), []
    compare = machine.landmarks.compare
    machine.landmarks.compare = lambda words: compared.append(len(words)) or compare(words)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(6)) for i in range(100_000)]
    first = machine.score([" ".join(words) + " idiot", "(idiot!)"], kept)
    again = machine.score([" ".join(w + "." for w in words[:50_000]) + " " + " ".join(words[50_000:]) + " 'idiot'", "idiot"], kept)
    assert sum(compared) == 100_001 and np.allclose(first, again)


def test_toxicity_inserted_letters():
    """Single insults with one or two real letters inserted, and long clean texts."""
    rng = random.Random(7)
    bad = ["moron", "idiot", "clown", "pathetic", "scum"]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts, toxic = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(rng.randrange(10, 200))]
        if i % 5 == 0:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(i % 5 == 0)
    machine = toxicity_ssk.train(texts, np.array(toxic))
    assert set(bad) <= set(machine.landmarks.words[: 2 * len(bad)])
    kept = toxicity_ssk.Words(machine.landmarks)

    def caught(count: int) -> float:
        out = []
        for i in range(200):
            w, one = [rng.choice(words) for _ in range(15)], list(rng.choice(bad))
            for _ in range(count):
                one.insert(rng.randrange(1, len(one)), rng.choice("abcdefghijklmnopqrstuvwxyz"))
            out.append(" ".join(w[:7] + ["".join(one)] + w[7:]))
        return (machine.score(out, kept) >= 0.7).mean()

    assert caught(0) > 0.95 and caught(1) > 0.8 and caught(2) > 0.5
    clean = [" ".join(rng.choice(words) for _ in range(n)) for n in [15] * 200 + [200] * 50 + [5000] * 5]
    assert (machine.score(clean, kept) < 0.7).mean() > 0.98


def test_toxicity(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    bad = ["moron", "idiot", "clown", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, t, None, None, 1) for i, t in enumerate(["an id-iot here", "such a mor0n", "you i d i o t now", "a clowwn", *ODD])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (99999, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_ssk.toxicity(docs, marks).collect()}
    apart = [i for i in range(600) if held_out(i)]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in apart]) > 0.97
    assert all(got[1000 + i]["predicted"] == 1 for i in range(4)) and not any(got[1004 + i]["predicted"] for i in range(len(ODD)))
    clean = toxicity_ssk.keep_clean(docs, marks)
    assert clean.columns == docs.columns and clean.count() == sum(not r["predicted"] for r in got.values())
    assert {r["score"] for r in toxicity_ssk.toxicity(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity_ssk.toxicity(empty(spark), marks).count() == 0


# 10
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, sf):
    enc = library()
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(60).collect()] + ODD + ODD
    got = {r["doc_id"]: r for r in byte_bpe.byte_bpe(frame(spark, texts), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.byte_bpe(empty(spark), RANKS).count() == 0


def test_huge_words():
    """Long unbroken runs are merged in time that grows with their length."""
    enc, mine = library(), bpe.RankEncoder(RANKS)
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(150_000)), "a" * 100_000, "日本" * 20_000]
    assert [enc.encode_ordinary(w) for w in words] == mine.encode_words([w.encode() for w in words])


def test_units_are_bounded():
    from marginalia.llm.common import Units

    kept = Units(10_000)
    for i in range(200):
        kept.ready()
        new = [f"{i}-{j}" for j in range(20)] + ["x" * 100 + str(i)]
        kept.update(dict.fromkeys(new, 1))
        kept.done(new, 100)
    assert len(kept) < 150 and not any(len(u) > 64 for u in kept)


def test_merges_of_any_length():
    enc, mine = library(), bpe.RankEncoder(RANKS)
    rng = random.Random(9)
    words = ["".join(rng.choice("aeinrst") for _ in range(n)) for n in [*range(1, 70), 300, 1100, 2500]]
    assert [enc.encode_ordinary(w) for w in words] == mine.encode_words([w.encode() for w in words])


def test_stages_with_odd_tables(spark, sf):
    """Clashing columns come back unchanged; nulls, repeated rows, empty tables have a rule."""
    import corpus_pipeline as p

    texts = [r["text"] for r in table(spark, sf, "documents").select("text").limit(40).collect()] + ODD
    docs = frame(spark, texts)
    docs = docs.union(docs.limit(5)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).cache()
    for _, stage in p.STAGES[:3]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns
        rows = left.collect()
        assert rows and all(r[c] == "clash" for r in rows for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars"))
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert p.packing(spark, docs, sf).select("doc_id").distinct().count() == len(texts) + 1
    with pytest.raises(TypeError):
        partenum.jaccard_groups(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_long_texts(spark):
    """Texts of a megabyte go through every operator."""
    rng = random.Random(8)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "moron"]) + str(rng.randrange(10**6)) for _ in range(90_000))
    docs = frame(spark, [long, long + " end", "x" * 1_000_000, "日本語" * 100_000])
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    assert lang_bigru.languages(docs).count() == toxicity_ssk.toxicity(docs, marks).count() == quality_mcd.quality(docs).count() == 4
    assert {r["doc_id"]: r["component_id"] for r in partenum.jaccard_groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.com").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert sorted(r["n_chars"] for r in template_extract.main_text(pages).collect()) == sorted(len(x) for x in (long, long + " end", "x" * 1_000_000, "日本語" * 100_000))
    assert warc_index.capture_index(pages).where("record_type = 'response'").count() == 4


def test_pipeline(spark, sf):
    """Each stage against its own operator's rule on the rows that the one before kept."""
    import corpus_pipeline as p

    docs = table(spark, sf, "documents").cache()
    good = p.quality_rules(spark, docs, sf)
    verdict = {r["doc_id"] for r in quality_mcd.quality(docs).where("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == verdict
    good = good.cache()
    clean = p.toxicity(spark, good, sf).cache()
    assert clean.columns == docs.columns
    single = p.near_duplicates(spark, clean, sf)
    groups = brute([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 8, 10)
    left = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and left == {i for i, (_, c) in groups.items() if i == c}
    assert {r["doc_id"] for r in p.run(spark, sf).select("doc_id").distinct().collect()} == left
