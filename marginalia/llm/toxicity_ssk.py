"""Toxicity by a support vector machine on a gapped-subsequence string kernel.

Words are compared with landmark words by the normalised kernel of common subsequences of four
letters, three for landmarks of three, where gaps only damp a match, so inserted characters
leave an insult close to itself. The kernel and its square are summed over the words of a text;
Nyström features of the landmarks' kernel matrices carry the sums to a linear machine, next to
each landmark's closest word and how far words stand out of what is usual in clean texts. It also
learns from its toxic texts with a single landmark word left, with and without letters inserted,
and from clean texts joined to long ones.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Units, held_out

#: Bounds of the labelled sample that the machine is fitted on: rows of each label, characters
#: of a row and of a label's rows.
TOXIC_ROWS, CLEAN_ROWS, ROW_CHARS, LABEL_CHARS = 1500, 3500, 500_000, 8_000_000
LANDMARKS, CANDIDATES = 64, 512
#: Subsequence length, damping a letter of span, powers of the kernel that are summed.
LENGTH, DAMP, POWERS = 4, np.float32(0.9), (1, 2)
#: Training weight of a toxic text with one of its landmark words left, and the numbers of letters
#: inserted in that.
STRETCH, COPIES = 0.3, (0, 1, 2)
#: Clean texts of one joined training text; weight of Nyström features.
JOINED, NYSTROM = 16, 0.2
#: A landmark's closest word stands out above the level that this share of clean texts keeps to.
USUAL = 0.995
#: Tokens over this many characters are read in windows that overlap by half.
WINDOW = 32
#: Cells of the kernel's tables that are filled at once, so that they stay in a core's cache.
CELLS = 200_000
_apart = "|,;:\"()<>/[]{}=+"
_spelled = re.compile(r"(?<![^\s])(?:\w[ .\-_*]){2,}\w(?![^\s.,;!?])")
_edge = ".-_!?*'%&$#~^`"
_inner = re.compile(r"[.\-_*'~^`]")
_like = str.maketrans("013457@$", "oieastas")


def pieces(text: str | None) -> list[str]:
    """Lower-case words of a whole text with the marks at their edges; letters spelled with blanks
    or marks between make one."""
    if not text:
        return []
    text = plain = text.lower()
    for c in _apart:
        plain = plain.replace(c, " ")
    return plain.split() + [re.sub(r"[ .\-_*]", "", x) for x in _spelled.findall(text)]


def tokens(text: str | None) -> list[str]:
    """Lower-case words of a whole text without the marks at their edges."""
    return [w for x in pieces(text) if (w := x.strip(_edge))]


def forms(word: str) -> list[str]:
    """What the kernel reads of a token: look-alike digits and signs as letters, inner marks
    dropped, long tokens in overlapping windows."""
    if not word.isalpha():
        letters = sum(c.isalpha() for c in word)
        if letters < 2:
            return []
        word = _inner.sub("", word).translate(_like)
    if len(word) <= WINDOW:
        return [word]
    return [word[s : s + WINDOW] for s in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def codes(words: list[str], width: int) -> np.ndarray:
    """Letters as numbers, rows padded by 0."""
    out, lens = np.zeros((len(words), width), np.int32), np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < lens[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def kernel(s: np.ndarray, t: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Gapped-subsequence kernel of rows of ``s`` with the same rows of ``t`` (padded codes).

    Divided by the damping of all letters before a place, what comes before it is a plain sum over
    both words, so each letter of a subsequence takes one product and two prefix sums.
    """
    s, t = np.ascontiguousarray(s.T)[:, None], np.ascontiguousarray(t.T)[None]
    same = ((s == t) & (s > 0)).astype(np.float32)
    damp = (DAMP ** (np.arange(same.shape[0])[:, None] + np.arange(same.shape[1]))).astype(np.float32)[..., None]
    now = same / damp
    for i in range(1, length):
        for a in range(1, now.shape[0]):
            now[a] += now[a - 1]
        for b in range(1, now.shape[1]):
            now[:, b] += now[:, b - 1]
        now = same[i:, i:] * now[:-1, :-1]
    return (now * (damp[length - 1 :, length - 1 :] * DAMP**2)).sum((0, 1))


class Subsequences:
    """Words that are compared with others by subsequences of one length."""

    def __init__(self, words: list[str], length: int):
        self.words, self.length = words, length
        # for the longest common subsequence: the places of each letter in each word as bits
        letters = sorted(set("".join(words)))
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.bits = np.uint32 if self.lens.max(initial=1) <= 32 else np.uint64
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)  # the last one for all others
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters)) + 1
        self.places = np.zeros((len(letters) + 1, len(words)), self.bits)
        for j, w in enumerate(words):
            for i, c in enumerate(w):
                self.places[self.letter[ord(c)], j] |= self.bits(1 << i)
        self.own = self.self_kernel(words)
        self.codes = codes(words, int(self.lens.max(initial=1)))

    def self_kernel(self, words: list[str]) -> np.ndarray:
        out, lens = np.zeros(len(words), np.float32), np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens):
            at = np.flatnonzero(lens == n)
            step = max(64, CELLS // max(1, n * n))
            for c in range(0, len(at), step):
                x = codes([words[i] for i in at[c : c + step]], int(n))
                out[at[c : c + step]] = kernel(x, x, self.length)
        return out

    def related(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, own word) pairs whose longest common subsequence has ``length`` letters or more,
        by the bit-parallel recurrence over all of both at once."""
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        order = order[np.searchsorted(lens[order], self.length) :]
        full = np.array([(1 << len(w)) - 1 for w in self.words], self.bits)
        for c in range(0, len(order), 512):
            part = order[c : c + 512]
            x = codes([words[i] for i in part], int(lens[part[-1]]))
            cls = self.letter[np.minimum(x, len(self.letter) - 1)]
            v = np.broadcast_to(full, (len(part), len(full))).copy()
            for t in range(x.shape[1]):
                u = v & self.places[cls[:, t]]
                v = (v + u) | (v - u)
            i, j = np.nonzero(np.bitwise_count(~v & full) >= self.length)
            rows.append(part[i])
            cols.append(j)
        return np.concatenate(rows), np.concatenate(cols)

    def compare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, own word, value): the normalised kernel where it isn't 0. It is 0 exactly where
        no subsequence of ``length`` letters is common, so these pairs are not evaluated."""
        rows, cols = self.related(words)
        used, place = np.unique(rows, return_inverse=True)
        picked = [words[i] for i in used]
        own = self.self_kernel(picked)
        lens = np.fromiter(map(len, picked), np.int64, len(picked))
        lens, widths = lens[place], self.lens[cols]
        value, order = np.zeros(len(rows), np.float32), np.lexsort((widths, lens))
        ends = np.flatnonzero(np.diff(lens[order]) | np.diff(widths[order])) + 1
        for at in np.split(order, ends) if len(order) else []:  # words of one length, own ones of one length
            n, m = int(lens[at[0]]), int(widths[at[0]])
            step = max(64, CELLS // (n * m))
            for c in range(0, len(at), step):
                p = at[c : c + step]
                some, each = np.unique(place[p], return_inverse=True)
                k = kernel(codes([picked[i] for i in some], n)[each], self.codes[cols[p], :m], self.length)
                value[p] = k / np.sqrt(own[place[p]] * self.own[cols[p]])
        keep = value > 0
        return rows[keep], cols[keep], value[keep]


class Landmarks:
    """Landmark words with their kernel matrices: those of three letters by subsequences of three
    letters, all others by such of ``LENGTH``. Shorter words match only themselves."""

    def __init__(self, words: list[str]):
        self.words = words
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.parts = []
        for length, which in ((3, lens == 3), (LENGTH, lens >= LENGTH)):
            at = np.flatnonzero(which)
            if len(at):
                self.parts.append((at, Subsequences([words[i] for i in at], length)))
        self.short = {w: j for j, w in enumerate(words) if len(w) < 3}
        k = self.dense(words)
        apart = (lens[:, None] >= LENGTH) != (lens >= LENGTH)  # the two lengths are kernels apart
        self.whiten = []
        for p in POWERS:
            value, vector = np.linalg.eigh(np.where(apart, 0, k**p + k.T**p) / 2 + 1e-3 * np.eye(len(words)))
            self.whiten.append(vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T)

    def compare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, value) where the normalised kernel isn't 0."""
        same = [(i, self.short[w]) for i, w in enumerate(words) if w in self.short]
        more = np.array(same, np.int64).reshape(-1, 2)
        found = [(more[:, 0], more[:, 1], np.ones(len(more), np.float32))]
        for at, part in self.parts:
            rows, cols, values = part.compare(words)
            found.append((rows, at[cols], values))
        return tuple(np.concatenate(x) for x in zip(*found))

    def dense(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.words)))
        rows, cols, values = self.compare(words)
        out[rows, cols] = values
        return out


class Words(Units):
    """Words, with or without marks at their edges, to rows of a sparse table of their kernel values, the
    largest of their forms. Row 0 is that of marks alone."""

    def __init__(self, landmarks: Landmarks, most: int = 64_000_000):
        super().__init__(most)
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        super().forget()
        #: A row's values lie between those places; landmarks and values.
        self.upto, self.cols, self.values = np.zeros(2, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)

    def learn(self, words: list[str]) -> int:
        """Add words; the bytes that their rows take."""
        plain = {x: x.strip(_edge) for x in words}
        new = list({w for w in plain.values() if w and w not in self})
        at, read = [], []
        for i, w in enumerate(new):
            for f in forms(w):
                at.append(i)
                read.append(f)
        rows, cols, values = self.landmarks.compare(read)
        width = len(self.landmarks.words)
        cells, place = np.unique(np.array(at, np.int64)[rows] * width + cols, return_inverse=True)
        most = np.zeros(len(cells), np.float32)
        np.maximum.at(most, place, values)
        first, counts = len(self.upto) - 1, np.bincount(cells // width, minlength=len(new))
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(counts)])
        self.cols = np.concatenate([self.cols, (cells % width).astype(np.int32)])
        self.values = np.concatenate([self.values, most])
        row = dict(zip(new, range(first, first + len(new))))
        self.update((x, row[w] if w in row else self[w] if w else 0) for x, w in plain.items())
        return 8 * len(new) + 8 * len(cells)


class Machine:
    """Landmarks and the linear machine over their features."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        n = len(landmarks.words)
        self.weights, self.slope, self.shift = np.zeros((2 * len(POWERS) + 3) * n + 1), 0.0, -2.0
        #: Of each landmark's closest word: the level usual in clean texts, and what the landmark
        #: itself has with two letters inserted.
        self.usual, self.gapped = np.zeros(n), np.ones(n)
        self.key = hashlib.md5(repr(landmarks.words).encode()).hexdigest()

    def totals(self, found: list[list[str]], kept: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Of texts as lists of words: their number, each landmark's sums of the powers of its
        kernel values and of their ways from the usual level to the gapped one, and its closest
        word's value."""
        kept.ready()
        new = [w for w in set().union(*found) if w not in kept]
        more = kept.learn(new)
        texts, width = len(found), len(self.usual)
        sums, best = [np.zeros(texts * width) for _ in (*POWERS, "way")], np.zeros(texts * width, np.float32)
        low, span = self.usual.astype(np.float32), (self.gapped - self.usual).astype(np.float32)
        lens = np.fromiter(map(len, found), np.int64, texts)
        place = np.fromiter(map(kept.__getitem__, chain.from_iterable(found)), np.int64, int(lens.sum()))
        text = np.repeat(np.arange(texts), lens)
        n = np.bincount(text, place > 0, texts).astype(np.int64)
        for s in range(0, len(place), 100_000):  # a block of words; a text may go on in the next one
            p = place[s : s + 100_000]
            first, size = kept.upto[p], kept.upto[p + 1] - kept.upto[p]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            k, c = kept.values[at], kept.cols[at]
            cell = np.repeat(text[s : s + 100_000] * width, size) + c
            np.maximum.at(best, cell, k)
            out = np.flatnonzero(k > low[c])  # few words stand out at all
            way = np.minimum((k[out] - low[c[out]]) / span[c[out]], 1)
            for total, cells, values in zip(sums, (cell, cell, cell[out]), (k, k * k, way)):
                total += np.bincount(cells, values, len(total))
        kept.done(new, 150, more)
        return n, [x.reshape(texts, width) for x in sums], best.reshape(texts, width).astype(np.float64)

    def features(self, n: np.ndarray, sums: list[np.ndarray], best: np.ndarray) -> np.ndarray:
        """Of such totals: each landmark's closest word, damped totals and densities of the powers
        in the landmarks' whitened spaces and of the ways from the usual to the gapped level,
        and a constant."""
        out = [best]
        for total, w in zip(sums, (*(NYSTROM * w for w in self.landmarks.whiten), np.eye(best.shape[1]))):
            out += [np.log1p(total) @ w, np.log1p(200 * total / (n[:, None] + 50)) @ w]
        return np.hstack([*out, np.ones((len(best), 1))])

    def score(self, texts: list[str | None], kept: Words) -> np.ndarray:
        """Probability that each whole text is toxic."""
        margin = self.features(*self.totals([pieces(t) for t in texts], kept)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3  # the constant
    for _ in range(50):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int) -> list[str]:
    """Words whose share of texts differs in favour of the toxic ones, by a z score, one after
    another by the score times the part of the word that those before leave in the kernel (its
    leverage), so that many forms of one word don't take all places."""
    pos, neg = Counter(), Counter()
    of = lambda t: {f for w in set(tokens(t)) for f in forms(w) if len(f) > 2}
    for i in np.flatnonzero(toxic):
        pos.update(of(texts[i]))
    pos = Counter({w: c for w, c in pos.items() if c >= 2})
    for i in np.flatnonzero(~toxic):
        neg.update(w for w in of(texts[i]) if w in pos)
    p, n = max(1, toxic.sum()), max(1, (~toxic).sum())
    scored = []
    for w, c in pos.items():
        a, b, m = c / p, neg[w] / n, (c + neg[w]) / (p + n)
        scored.append(((a - b) / np.sqrt(m * (1 - m) * (1 / p + 1 / n) + 1e-12), w))
    scored = [(z, w) for z, w in sorted(scored, key=lambda x: (-x[0], x[1]))[:CANDIDATES] if z > 0]
    if not scored:
        return []
    words, z = [w for _, w in scored], np.array([z for z, _ in scored])
    k = Landmarks(words).dense(words)
    left, rows, chosen = np.ones(len(words)), np.zeros((0, len(words))), []
    while len(chosen) < min(most, len(words)):
        i = int((z * left).argmax())
        if left[i] < 1e-3:
            break
        row = (k[i] - rows[:, i] @ rows) / np.sqrt(left[i])
        rows, left = np.vstack([rows, row]), np.maximum(left - row**2, 0)
        left[i] = 0
        chosen.append(words[i])
    return chosen


def stretched(word: str, letters: str, count: int, rng: np.random.Generator) -> str:
    """A word with letters inserted inside it."""
    for i in sorted(rng.integers(1, len(word), count).tolist(), reverse=True):
        word = word[:i] + letters[rng.integers(len(letters))] + word[i:]
    return word


def alone(words: list[str], landmarks: set[str], letters: str, count: int, rng: np.random.Generator) -> list[str]:
    """A text's words with one of its landmark words left, letters inserted in it."""
    found = sorted(landmarks.intersection(words))
    one = found[rng.integers(len(found))]
    return [stretched(w, letters, count, rng) if w == one else w for w in words if w == one or w not in landmarks]


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Machine | None:
    """Fit landmarks, machine and probability scale; None without both labels."""
    if toxic.all() or not toxic.any():
        return None
    words = choose_landmarks(texts, toxic, landmarks)
    if not words:
        return None
    machine = Machine(Landmarks(words))
    kept, chosen = Words(machine.landmarks, 30_000_000), set(words)
    letters = "".join(sorted({c for w in words for c in w}))

    def totals(which: np.ndarray, count: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Totals of some texts, in blocks, so that few words are in memory at a time; with
        ``count``, of what ``alone`` makes of them."""
        out, part, size = [machine.totals([], kept)], [], 0
        for k, i in enumerate(which.tolist()):
            part.append(tokens(texts[i]))
            size += len(texts[i])
            if count is not None:
                part[-1] = alone(part[-1], chosen, letters, count, np.random.default_rng([count, i]))
            if size > 1_000_000 or len(part) == 500 or k == len(which) - 1:
                out.append(machine.totals(part, kept))
                part, size = [], 0
        n, sums, best = zip(*out)
        return np.concatenate(n), [np.concatenate(t) for t in zip(*sums)], np.concatenate(best)

    machine.usual = np.quantile(totals(np.flatnonzero(~toxic))[2], USUAL, axis=0)
    rng = np.random.default_rng(0)
    gapped = machine.landmarks.dense([stretched(w, letters, 2, rng) for w in words for _ in range(8)])
    gapped = gapped.reshape(len(words), 8, len(words)).mean(1).diagonal()
    machine.gapped = np.maximum(gapped, machine.usual + 0.05)
    fold = np.arange(len(texts)) % 4
    n, sums, best = totals(np.arange(len(texts)))
    x = machine.features(n, sums, best)
    bad = np.array([i for i in np.flatnonzero(toxic) if not chosen.isdisjoint(tokens(texts[i]))], np.int64)
    more = [machine.features(*totals(bad, count)) for count in COPIES]
    # clean texts joined are clean as well: totals of several texts of a fold, added up
    joins = [c[s : s + JOINED] for k in range(4) for c in [np.flatnonzero(~toxic & (fold == k))] for s in range(0, len(c), JOINED)]
    first, order = np.cumsum([0] + [len(j) for j in joins[:-1]]), np.concatenate(joins)
    more.append(machine.features(np.add.reduceat(n[order], first), [np.add.reduceat(t[order], first) for t in sums], np.maximum.reduceat(best[order], first)))
    more = np.concatenate(more)
    again = np.concatenate([np.tile(fold[bad], len(COPIES)), fold[order[first]]])
    sign = np.repeat([1.0, -1.0], [len(COPIES) * len(bad), len(joins)])
    y = np.where(toxic, 1.0, -1.0)
    cost = np.where(toxic, min(4.0, (~toxic).sum() / toxic.sum()), 1.0)
    extra = np.where(sign > 0, STRETCH * cost.max(), 1.0)

    def fitted(on: np.ndarray, also: np.ndarray) -> np.ndarray:
        return squared_hinge(np.concatenate([x[on], more[also]]), np.concatenate([y[on], sign[also]]), np.concatenate([cost[on], extra[also]]))

    margin, others = np.zeros(len(y)), np.zeros(len(again))
    for k in range(4):
        w = fitted(fold != k, again != k)
        margin[fold == k], others[again == k] = x[fold == k] @ w, more[again == k] @ w
    machine.weights = fitted(fold >= 0, again >= 0)
    a, b = 1.0, 0.0  # logistic scale of the margins of texts left out, by Newton steps
    margin, label = np.concatenate([margin, others]), np.concatenate([toxic, sign > 0])
    share = np.concatenate([np.ones(len(y)), np.where(sign > 0, STRETCH, 1.0)])
    t = np.where(label, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(share * (p - t) * margin).sum() + 1e-3 * a, (share * (p - t)).sum()])
        v = share * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    machine.slope, machine.shift = float(max(a, 1e-3)), float(b)
    return machine


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_rows: int, clean_rows: int) -> list[tuple[str, bool]]:
    """Labelled texts outside the held-out third: of each label at most so many ids, the first by
    a hash of the id, and of their texts as many as ``ROW_CHARS`` and ``LABEL_CHARS`` allow, one
    an id. First ids, then lengths, then those texts come to the driver, all of bounded size."""
    known = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("string").alias("id")).agg((F.max("toxic") > 0).alias("toxic")).withColumn("place", F.xxhash64("id"))
    picked = known.where("toxic").orderBy("place", "id").limit(toxic_rows).union(known.where("not toxic").orderBy("place", "id").limit(clean_rows)).collect()
    spark, schema = docs.sparkSession, "id string, toxic boolean, place long"
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.length(text_col).alias("n")).where(F.col("n") <= ROW_CHARS)
    sizes = texts.join(F.broadcast(spark.createDataFrame(picked, schema)), "id").groupBy("id", "toxic", "place").agg(F.min("n").alias("n")).collect()
    left, chosen = {True: LABEL_CHARS, False: LABEL_CHARS}, []
    for r in sorted(sizes, key=lambda r: (r["place"], r["id"])):
        left[r["toxic"]] -= r["n"]
        if left[r["toxic"]] >= 0:
            chosen.append((r["id"], r["toxic"], r["place"]))
    rows = texts.join(F.broadcast(spark.createDataFrame(chosen, schema)), "id").groupBy("id", "toxic").agg(F.min(F.struct("n", "text")).alias("x")).collect()
    return [(r["x"]["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["id"])]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Machine | None:
    """Train on the labelled sample."""
    rows = sample(docs, labels, id_col, text_col, toxic_rows, clean_rows)
    return train([t for t, _ in rows], np.array([y for _, y in rows], bool))


_memory: dict[str, Words] = {}


def score_column(machine: Machine | None, text: Column) -> Column:
    """Probability that a whole text is toxic; without a machine 0 for every text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if machine is None:
                yield pd.Series(np.zeros(len(texts)))
                continue
            if machine.key not in _memory:
                _memory.clear()
                _memory[machine.key] = Words(machine.landmarks)
            out, part, size, texts = [], [], 0, texts.tolist()
            for i, t in enumerate(texts):
                part.append(t)
                size += len(t or "")
                if size > 2_000_000 or len(part) == 1000 or i == len(texts) - 1:
                    out.append(machine.score(part, _memory[machine.key]))
                    part, size = [], 0
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts get the score of a text without words. Labels of unknown documents
    and null labels are not used; of several labels of one id the highest holds. Repeated rows
    are scored each. Null ids are scored, not held out. Ids of documents and labels are compared
    as text. Without both labels among the training rows every score is 0. An empty table gives
    no rows, extra columns are not read.
    """
    machine = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_column(machine, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score stays below the threshold; edge cases
    as for ``toxicity``, so null and empty texts stay."""
    machine = fit(docs, labels, id_col, text_col)
    return docs.where(score_column(machine, F.col(text_col)) < threshold)
