"""Edit distances of many pairs side by side: equal to those one by one, over tiles, in less time."""

import random
import time

import numpy as np
import pytest
from marginalia.operators import distances as D
from marginalia.operators import similar


def text(rng, n, letters="abcdé😀"):
    return "".join(rng.choice(letters) for _ in range(n))


def changed(rng, x, share):
    y = list(x)
    for _ in range(rng.randrange(1 + int(len(y) * share))):
        i = rng.randrange(len(y) + 1)
        y[i : i + rng.randrange(3)] = rng.choice(["", "q", "ab"])
    return "".join(y)


@pytest.mark.parametrize("places", [D.PLACES, 4000])
def test_side_by_side(monkeypatch, places):
    """Random texts and changed ones, lengths about multiples of 64, bounds from 0 to the whole length."""
    monkeypatch.setattr(D, "PLACES", places)
    rng, pairs, most = random.Random(7), [("", ""), ("", "a"), ("ab", "")], [0, 0, 2]
    for _ in range(2500):
        n = rng.choice([1, 5, 63, 64, 65, 127, 128, 129, 200, 330])
        x = text(rng, n - rng.randrange(1 + n // 8))
        y = changed(rng, x, rng.choice([0.05, 0.5, 1])) if rng.random() < 0.7 else text(rng, n - rng.randrange(1 + n // 3))
        pairs.append((x, y) if rng.random() < 0.5 else (y, x))
        most.append(rng.randrange(1 + max(len(x), len(y), 1)) if rng.random() < 0.8 else similar.most_edits(max(len(x), len(y)), 0.5))
    used = []
    side = D._side_by_side
    monkeypatch.setattr(D, "_side_by_side", lambda p, m: used.append(len(p)) or side(p, m))
    got = D.distances(pairs, np.array(most), similar.edits)
    want = [similar.edits(x, y, k) for (x, y), k in zip(pairs, most)]
    assert got.tolist() == [-1 if d is None else d for d in want]
    assert sum(used) > 1500 and 500 < sum(d is not None for d in want) < 2400


def tiles(rng, n, rows, size):
    return [[{"g": g, "id": {"rank": i % 2, "item": i}, "texts": [text(rng, size, "theranodisw ")], "side": 2} for i in range(rows)] for g in range(n)]


def test_pairs_of_many_tiles_together(monkeypatch):
    rng, calls = random.Random(8), []
    dealt = tiles(rng, 40, 6, 100)
    for rows in dealt:
        rows[3]["texts"] = ["x" + rows[0]["texts"][0]]
    whole = similar.distances
    monkeypatch.setattr(similar, "distances", lambda p, m, one: calls.append(len(p)) or whole(p, m, one))
    order = lambda r: tuple(r["id"].values())
    found = [x for part in similar.near_pairs(dealt, [0.5], order) for x in part]
    near = lambda x, y: similar.edits(x, y, similar.most_edits(max(len(x), len(y)), 0.5)) is not None
    want = {(r["g"], q["id"]["item"], r["id"]["item"]) for rows in dealt for q in rows for r in rows if order(q) < order(r) and near(q["texts"][0], r["texts"][0])}
    assert {(u["g"], u["id"]["item"], v["id"]["item"]) for u, v, _ in found} == want and len(want) >= 40
    assert len(calls) == 1
    monkeypatch.setattr(similar, "HELD_PAIRS", 50)
    again = [x for part in similar.near_pairs(dealt, [0.5], order) for x in part]
    key = lambda x: (x[0]["g"], x[0]["id"]["item"], x[1]["id"]["item"], x[2])
    assert sorted(map(key, again)) == sorted(map(key, found)) and len(calls) > 2
    apart = {key(x)[:3] for part in similar.near_pairs(dealt, [0.5], order, "rank") for x in part}
    assert apart == {(g, a, b) for g, a, b in want if a % 2 != b % 2} and apart


def test_time_a_pair():
    """Unlike pairs at a weak threshold, the bulk of the work: well under half the time of one by one."""
    rng = random.Random(9)
    pairs = [(text(rng, 400, "theranodisw "), text(rng, 400, "theranodisw ")) for _ in range(1500)]
    most = np.full(len(pairs), similar.most_edits(400, 0.5))
    began = time.time()
    got = D.distances(pairs, most, similar.edits)
    mid = time.time()
    want = [similar.edits(x, y, int(most[0])) for x, y in pairs[:300]]
    end = time.time()
    assert got[:300].tolist() == [-1 if d is None else d for d in want]
    assert (mid - began) / len(pairs) < 0.5 * (end - mid) / 300
