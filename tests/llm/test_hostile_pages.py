"""The template extractor on deep, broken and misleading html, and against a plain extractor."""

import random
import time
import tracemalloc

import pytest

from marginalia.llm import template_extract as T


def long_text(i):
    return " ".join(f"w{i}x{j}" for j in range(30))


def article(i, body):
    body = f"<p>{long_text(i)}</p>{body}"
    return f"<html><body><div class=q1><a href=/>Home</a></div><article><h1>Title {i}</h1>{body}</article><div class=q3>All rights {i % 2}</div></body></html>"


def deep(n):
    return "<div>" * n + "".join(f"<p>t{i}</div>" for i in range(n))


def test_deep_page():
    """100,000 open elements with a text each are read in one pass; memory grows as the page."""
    page = T.parse(deep(100_000))
    assert len(page.texts) == 100_000 and len(page.paths) == 200_001
    most = []
    for n in (5_000, 20_000):
        tracemalloc.start()
        text = T.extract([deep(n)])[0]
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert text.count("\n") > 0.8 * n  # the element around most of the text
    assert most[1] < 6 * most[0]


def test_deep_host():
    """Pages of one deep layout have a template, which is written and read in proportion to their depth."""
    pages = ["<div>" * 3000 + f"<p>{' '.join(f'w{i}x{j}' for j in range(60))}</p>" + "</div>" * 3000 for i in range(6)]
    paths = T.Paths()
    made = T.deduce([T.parse(p, paths) for p in pages])
    again = T.Template.load(made.dump())
    assert len(made.dump()) < 200_000
    assert [T.read(T.parse(p, T.Paths(again.paths)), again) for p in pages] == T.extract(pages) == [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]


@pytest.mark.parametrize("part", ["<script ", "<script>", "<!-- ", "<style a", "<textarea>x"])
def test_unclosed_is_linear(part):
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        T.parse("<p>before</p>" + part * n)
        took.append(time.time() - began)
    assert took[1] < 1 + 12 * took[0]
    assert T.extract(["<p>before</p>" + part * 1000])[0].startswith("before")


@pytest.mark.parametrize("name", ["social-policy", "notice-period", "ad-hoc", "related-work", "share-price", "widget-factory-visit", "promotions"])
def test_names_that_only_hold_a_listed_word(name):
    pages = [article(i, f"<p>one {i}</p><div class={name}><p>about {i} it</p></div><p>two {i}</p>") for i in range(9)]
    assert T.extract(pages) == [f"Title {i}\n{long_text(i)}\none {i}\nabout {i} it\ntwo {i}" for i in range(9)]


@pytest.mark.parametrize("name", ["comments", "comment-list", "site-footer", "related-posts", "ad", "ad-box", "cookie-notice", "share-buttons"])
def test_names_of_boilerplate(name):
    pages = [article(i, f"<p>one {i}</p><div class='x {name}'><p>nice {i} said</p></div><p>two {i}</p>") for i in range(9)]
    assert T.extract(pages) == [f"Title {i}\n{long_text(i)}\none {i}\ntwo {i}" for i in range(9)]


def test_math_and_object_keep_their_text():
    pages = [article(i, f"<p>area <math><mi>a{i}</mi><mo>=</mo></math> and</p><object data=x><p>fallback {i}</p></object>") for i in range(9)]
    assert T.extract(pages) == [f"Title {i}\n{long_text(i)}\narea a{i}= and\nfallback {i}" for i in range(9)]


def plain(i, blocks):
    return "\n".join([f"Title {i}", long_text(i), *blocks])


@pytest.mark.parametrize("n", range(1, 9))
def test_hosts_of_few_pages(n):
    """From one page on, with a name for the article; from four on without one."""
    rng = random.Random(n)
    blocks = [[" ".join(f"w{rng.randrange(999)}" for _ in range(30)) for _ in range(4)] for _ in range(n)]
    pages = [article(i, "".join(f"<p>{b}</p>" for b in blocks[i])) for i in range(n)]
    assert T.extract(pages) == [plain(i, blocks[i]) for i in range(n)]
    if n >= T.LEAST:
        bare = [p.replace("article>", "div>") for p in pages]
        assert T.extract(bare, labels=False) == [plain(i, blocks[i]) for i in range(n)]


def test_paths():
    base = T.Paths()
    a = base.child(0, "a")
    b = base.child(a, "b")
    own = T.Paths(base)
    c = own.child(b, "c")
    assert own.child(a, "b") == b and own.child(b, "c") == c and len(base) == 3 and own.depth(c) == 3
    below = own.below(a)
    assert below(c) and below(a) and not below(0) and not own.below(c)(b) and own.below(0)(c)
    assert own.summed({c: 5, a: 1})[0] == 6 and own.summed({c: 5, a: 1})[b] == 5


def test_template_from_all_pages(spark):
    """What 90 % of all 200 pages of a host hold is a notice, what 89.5 % hold is not: no choice of some pages tells them apart
    on every host. Copies of pages change nothing."""

    def body(i, host):
        said = "<p>Offer ends soon</p>" if (i % 10 if host % 2 else i % 10 and i != 1) else ""
        return article(i, said + f"<p>one {i}</p>")

    rows = [(1000 * h + i, f"http://h{h}.example.com/{i}", body(i, h)) for h in range(8) for i in range(200)]
    rows += [(10_000 + j, "http://h1.example.com/0", rows[200][2]) for j in range(100)]
    rows.append((20_000, "http://deep.example.com", deep(3000)))
    got = dict(T.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).select("page_id", "text").collect())
    assert got.pop(20_000).count("\n") > 2400
    for k, url, html in rows[:-1]:
        i = k % 1000 if k < 10_000 else 0
        offer = ["Offer ends soon"] if "Offer" in html and "h1." not in url and k // 1000 % 2 == 0 else []
        assert got[k] == plain(i, [*offer, f"one {i}"]), k


def test_slots_are_filled_in_one_pass(spark, monkeypatch):
    """The pages of all hosts go through Python once for what stands in slots and for the gaps of tokens."""
    plans, cut = {}, T.cut
    monkeypatch.setattr(T, "cut", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or cut(df, label))
    rows = [(i, f"http://a.example.com/{i}", article(i, f"<p>one {i}</p>")) for i in range(9)]
    got = T.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()
    assert dict(got) == {i: plain(i, [f"one {i}"]) for i in range(9)}
    assert plans["host-templates"].count("MapInArrow") == 1
