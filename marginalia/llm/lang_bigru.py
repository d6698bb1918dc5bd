"""Language of documents by a bidirectional gated recurrent network over bytes.

The network labels every byte position; a document's probabilities are the mean over all its
positions. It is trained in numpy by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Units a direction, bytes of a segment, bytes before and after it that are read to warm up both
#: directions' states, segments computed together.
HIDDEN, SEGMENT, WARM, TOGETHER = 8, 480, 32, 1024
#: Bound of the training sample in documents a language and spans a document; steps, spans a step
#: and bytes of a span.
SAMPLE, SPANS, STEPS, BATCH, SPAN = 300, 32, 350, 128, 64
_letter = re.compile(r"[^\W\d_]")


class Direction:
    """One direction's weights: a byte's input to the gates (update, reset, candidate) and the
    recurrent matrix."""

    def __init__(self, rng, hidden: int):
        self.x = rng.normal(0, 0.3, (3 * hidden, 256))
        self.u = rng.normal(0, 0.7 / np.sqrt(hidden), (3 * hidden, hidden))

    def forward(self, bytes_: np.ndarray, real: np.ndarray) -> list[tuple]:
        """States a step, kept for the way back; padded steps leave the state at zero."""
        n = self.u.shape[1]
        h, kept = np.zeros((n, bytes_.shape[1])), []
        for t in range(len(bytes_)):
            g, u = self.x[:, bytes_[t]], self.u @ h
            zr = 1 / (1 + np.exp(-(g[: 2 * n] + u[: 2 * n])))
            z, r = zr[:n], zr[n:]
            c = np.tanh(g[2 * n :] + r * u[2 * n :])
            new = (c + z * (h - c)) * real[t]
            kept.append((h, z, r, c, u[2 * n :], new))
            h = new
        return kept

    def backward(self, bytes_: np.ndarray, real: np.ndarray, kept: list[tuple], into: list[np.ndarray]):
        """Gradients of the weights, given those that reach each step's state from outside."""
        n = self.u.shape[1]
        du, gates, carry = np.zeros_like(self.u), [None] * len(bytes_), np.zeros_like(kept[0][0])
        for t in range(len(bytes_) - 1, -1, -1):
            h, z, r, c, uc, _ = kept[t]
            d = (into[t] + carry) * real[t]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            rec = np.concatenate([dz, dr, dc * r])
            gates[t] = np.concatenate([dz, dr, dc])
            du += rec @ h.T
            carry = d * z + self.u.T @ rec
        flat, at = np.stack(gates, 1).reshape(3 * n, -1), bytes_.ravel()
        return np.stack([np.bincount(at, row, 256) for row in flat]), du


class Network:
    """Two directions and the layer that labels each position from both states."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.there, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.v = rng.normal(0, 0.3, (len(langs), 2 * hidden))
        self.c = np.zeros((len(langs), 1))

    def weights(self) -> list[np.ndarray]:
        return [self.there.x, self.there.u, self.back.x, self.back.u, self.v, self.c]

    def gradients(self, bytes_: np.ndarray, lens: np.ndarray, label: np.ndarray):
        """Mean cross entropy over real positions and its gradients, for (time, row) bytes."""
        steps, rows = bytes_.shape
        real = (np.arange(steps)[:, None] < lens).astype(float)
        there = self.there.forward(bytes_, real)
        back = self.back.forward(bytes_[::-1], real[::-1])
        h = np.stack([np.concatenate([there[t][5], back[steps - 1 - t][5]]) for t in range(steps)], 1)
        flat = h.reshape(2 * self.hidden, -1)
        logits = self.v @ flat + self.c
        logits -= logits.max(0)
        p = np.exp(logits)
        p /= p.sum(0)
        want = np.tile(label, steps)
        weight = real.ravel() / max(1.0, real.sum())
        loss = -(np.log(p[want, np.arange(len(want))] + 1e-12) * weight).sum()
        p[want, np.arange(len(want))] -= 1
        d = p * weight
        dh = (self.v.T @ d).reshape(2 * self.hidden, steps, rows)
        n = self.hidden
        dx, du = self.there.backward(bytes_, real, there, [dh[:n, t] for t in range(steps)])
        bx, bu = self.back.backward(bytes_[::-1], real[::-1], back, [dh[n:, steps - 1 - t] for t in range(steps)])
        return loss, [dx, du, bx, bu, d @ flat.T, d.sum(1, keepdims=True)]

    def frozen(self) -> "Frozen":
        return Frozen(self)


class Frozen:
    """The network for labelling: single precision, gate inputs halved so that one hyperbolic
    tangent gives both sigmoid gates."""

    def __init__(self, net: Network):
        half = np.ones((3 * net.hidden, 1))
        half[: 2 * net.hidden] = 0.5
        self.langs, self.hidden = net.langs, net.hidden
        self.sides = [(np.ascontiguousarray(s.x * half, np.float32), np.ascontiguousarray(s.u * half, np.float32)) for s in (net.there, net.back)]
        self.v = [np.ascontiguousarray(net.v[:, : net.hidden], np.float32), np.ascontiguousarray(net.v[:, net.hidden :], np.float32)]
        self.c = net.c.astype(np.float32)

    def positions(self, bytes_: np.ndarray, lens: np.ndarray | None) -> np.ndarray:
        """Probabilities (time, language, row) of every position; where rows are padded, ``lens``
        are their lengths and what follows says nothing."""
        steps, rows = bytes_.shape
        n = self.hidden
        logits = np.zeros((steps, len(self.langs), rows), np.float32)
        logits += self.c
        g, u = np.empty((3 * n, rows), np.float32), np.empty((3 * n, rows), np.float32)
        for side, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            x, w = self.sides[side]
            h = np.zeros((n, rows), np.float32)
            for t in order:
                np.take(x, bytes_[t], axis=1, out=g, mode="clip")
                np.dot(w, h, out=u)
                zr, c, uc = g[: 2 * n], g[2 * n :], u[2 * n :]
                zr += u[: 2 * n]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                uc *= zr[n:]
                c += uc
                np.tanh(c, out=c)
                h -= c
                h *= zr[:n]
                h += c
                if lens is not None:
                    h *= t < lens
                logits[t] += self.v[side] @ h
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities (row, language) over all positions of each whole text.

        Texts are cut into segments that are read with ``WARM`` bytes on either side, which
        count for the states alone: gates forget, so the states there are those of the whole
        text but for a small rest, and at the ends of a text exactly so.
        """
        data = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        out = np.zeros((len(data), len(self.langs)))
        width = SEGMENT + 2 * WARM
        raw = np.frombuffer(b"".join(data) + bytes(width), np.uint8)
        parts = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(data)), parts)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        begin = np.maximum(0, first - WARM)
        lens = np.minimum(sizes[doc], first + SEGMENT + WARM) - begin
        lo, hi = first - begin, np.minimum(sizes[doc], first + SEGMENT) - begin  # what counts
        begin = begin + (np.cumsum(sizes) - sizes)[doc]
        steps = np.arange(width)[:, None]
        order = np.argsort(lens, kind="stable")  # short texts share short blocks
        for s in range(0, len(order), TOGETHER):
            k = order[s : s + TOGETHER]
            n = int(lens[k].max())
            block = np.ascontiguousarray(raw[begin[k][:, None] + np.arange(n)].T).astype(np.intp)
            inner = ((steps[:n] >= lo[k]) & (steps[:n] < hi[k])).astype(np.float32)
            p = np.einsum("tlr,tr->lr", self.positions(block, None if lens[k].min() == n else lens[k]), inner)
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(doc[k], p[j], len(data))
        return out / np.maximum(sizes, 1)[:, None]


def train(spans: list[list[bytes]], langs: list[str], steps: int = STEPS, seed: int = 11) -> Network | None:
    """Fit the network by Adam on spans of documents, languages in equal shares; None without rows."""
    rows = [([x[:SPAN] for x in xs if x], l) for xs, l in zip(spans, langs)]
    rows = [(xs, l) for xs, l in rows if xs]
    names = sorted({l for _, l in rows})
    if not names:
        return None
    by = {k: [xs for xs, l in rows if l == name] for k, name in enumerate(names)}
    rng, net = np.random.default_rng(seed), Network(names)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(names), BATCH)
        batch, lens = np.zeros((BATCH, SPAN), np.int64), np.zeros(BATCH, np.int64)
        for i, k in enumerate(label):
            xs = by[int(k)][rng.integers(len(by[int(k)]))]
            x = np.frombuffer(xs[rng.integers(len(xs))], np.uint8)
            batch[i, : len(x)], lens[i] = x, len(x)
        _, grads = net.gradients(batch.T, lens, label)
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        rate = 0.03 * min(1.0, step / 20) * (1 - step / (steps + 1))
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Train on at most ``sample`` documents a language outside the held-out third.

    Counts a language fix the share of a hash of the id that is read, about twice the bound;
    of the first of those by the hash ``SPANS`` spans of ``SPAN`` bytes, at hashed places of the
    whole text, come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    whole = 2**30
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(whole * min(1.0, 2 * sample / n)))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(whole))
    room = F.greatest(F.lit(1), F.octet_length("text") - (SPAN - 1))
    spans = F.transform(F.sequence(F.lit(1), F.lit(SPANS)), lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), room) + 1).cast("int"), SPAN))
    picked = rows.where(place < F.element_at(shares, F.col("lang"))).select("lang", spans.alias("spans"), place.alias("place"), "doc_id")
    picked = picked.orderBy("place", "doc_id").limit(3 * sample * len(counts)).collect()
    found, langs, taken = [], [], dict.fromkeys(counts, 0)
    for r in picked:
        if taken[r["lang"]] < sample:
            taken[r["lang"]] += 1
            found.append([bytes(x) for x in r["spans"]])
            langs.append(r["lang"])
    return train(found, langs)


def language_column(net: Network | None, text: Column) -> Column:
    """struct(lang_pred, score) of whole texts."""
    frozen = net.frozen() if net else None

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if frozen and t and _letter.search(t)]
            upto = np.cumsum([0] + [len(texts.iloc[i]) for i in at])
            s = 0
            while s < len(at):  # parts of bounded rows and characters
                e = max(s + 1, min(s + 1000, int(np.searchsorted(upto, upto[s] + 4_000_000, "right")) - 1))
                k, s = at[s:e], e
                p = frozen.documents([texts.iloc[i] for i in k])
                best = p.argmax(1)
                for i, b, row in zip(k, best, p):
                    found[i], score[i] = frozen.langs[b], min(1.0, float(row[b]))
            yield pd.DataFrame({"lang_pred": found, "score": score})

    return label(text)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned.
    Repeated rows are labelled each, null ids too; those are not held out. Equal probabilities go
    to the first language by name. Extra columns are not read.
    """
    net = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), language_column(net, F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))
