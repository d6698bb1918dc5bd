"""The training-data operators on inputs of a size or kind that other tests do not reach."""

import random

from pyspark.sql import functions as F

from marginalia.llm import partenum, template_extract
from marginalia.llm.components import state


def test_state_of_many_edges(spark):
    """20 million edges: their 40-bit hashes add up to more than a bigint holds."""
    many = spark.range(20_000_000).select(F.col("id").alias("u"), F.lit(-1).cast("long").alias("v"))
    n, hashes = state(many)
    assert n == 20_000_000 and hashes is not None


def test_open_bucket_in_blocks(spark, monkeypatch):
    """A bucket of many components is compared in blocks of bounded size, and all its links found."""
    likely = partenum.likely_pairs

    def few(ids, *more):
        assert len(ids) <= 40, f"{len(ids)} classes of a bucket in one task"
        return likely(ids, *more)

    monkeypatch.setattr(partenum, "BUCKET_ROWS", 10, raising=False)
    monkeypatch.setattr(partenum, "likely_pairs", few)
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(100)]
    # 60 near copies of one text and 150 pairs of near copies; all have 100 words in common
    texts = [" ".join(shared + ["m"] * 3 + [f"x{i}"]) for i in range(60)]
    for i in range(150):
        own = [f"o{rng.randrange(5000)}" for _ in range(12)]
        texts += [" ".join(shared + own), " ".join(shared + own[:-1] + ["z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in partenum.jaccard_groups(docs, 1, 9, 10).collect()}
    sets = [set(t.split()) for t in texts]
    to = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]) and to[a] != to[b]:
                x, y = sorted((to[a], to[b]))
                to = [x if t == y else t for t in to]
    assert got == dict(enumerate(to)) and len(set(to)) > 40


def test_slot_of_one_page():
    """A long text in a slot that no other page of the host fills stays, as on the page alone."""
    words = " ".join(f"word{i}" for i in range(300))
    page = "<body><div class=top>{}</div><section></section><div class=body>{}</div><hr></body>"
    pages = [page.format(f"page {i}", "") for i in range(47)] + [page.format("page 47", words)]
    assert words in template_extract.extract(pages[-1:])[0]
    assert words in template_extract.extract(pages)[-1]
