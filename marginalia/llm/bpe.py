"""Byte-pair merging of many words at once, in length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
import json
import re

import numpy as np

NONE = np.int32(2**31 - 1)
PAD = -1
#: Rows longer than this use a heap instead of a matrix row; same merges, O(n log n).
LONG_ROW = 1024
_WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, LONG_ROW])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_spaced = re.compile(r"\s ")
_stable = re.compile(r"(?<=\S)(?= )")


def stable_units(text: str) -> list[str]:
    """Cut a text before every space that follows a non-space character.

    No match of the byte-level pattern holds white space after another character, so a
    pattern match always ends there whatever stands to the left or right: each unit has the
    tokens of its own, and their concatenation is the encoding of the text.
    """
    if not text:
        return []
    if text[0] == " " or _spaced.search(text):
        return [x for x in _stable.split(text) if x]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class PairTable:
    """Open-addressing hash from a pair of ids to its rank and merged id, probed in bulk."""

    def __init__(self, left, right, rank, merged):
        keys = self.key(np.asarray(left, np.int64), np.asarray(right, np.int64))
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.mask = np.int64(2**self.bits - 1)
        self.keys = np.full(2**self.bits, -1, np.int64)
        self.rank = np.full(2**self.bits, NONE, np.int32)
        self.merged = np.full(2**self.bits, PAD, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.rank[at], self.merged[at] = keys[todo[won]], rank[todo[won]], merged[todo[won]]
            rest = np.setdiff1d(np.arange(len(todo)), won)
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    @staticmethod
    def key(left, right):
        return (left.astype(np.int64) << 20) | right.astype(np.int64)

    def slot(self, keys):
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs; -1 where a pair doesn't merge or holds padding."""
        keys = self.key(left, right)
        found = np.full(keys.shape, -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self.slot(keys[todo])
        while len(todo):
            here = self.keys[slot]
            hit = here == keys[todo]
            found[todo[hit]] = slot[hit]
            on = ~hit & (here != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return found

    def ranks(self, left, right):
        """Ranks, and merged ids, of the pairs; NONE where a pair doesn't merge."""
        at = self.find(left, right)
        return np.where(at >= 0, self.rank[at], NONE), np.where(at >= 0, self.merged[at], PAD)


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge every row of a padded matrix: each round, each row that still can merges its
    leftmost pair of minimum rank, and all are compacted by one column. Returns the rows,
    padded again."""
    n, width = ids.shape
    out = np.full((n, width), PAD, np.int32)
    rows = np.arange(n)
    rank = np.full((n, 0), NONE)
    if width > 1:
        rank, to = (x.reshape(n, width - 1) for x in pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
    while len(rows):
        w = ids.shape[1]
        if w < 2:
            out[rows, :w] = ids
            break
        at = rank.argmin(1)
        ended = rank[np.arange(len(rows)), at] == NONE
        if ended.any():
            out[rows[ended], :w] = ids[ended]
            on = ~ended
            rows, ids, rank, to, at = rows[on], ids[on], rank[on], to[on], at[on]
        each = np.arange(len(rows))
        ids[each, at] = to[each, at]
        cols = np.arange(w - 1)
        ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
        cols = np.arange(w - 2)
        shift = cols + (cols >= at[:, None])
        rank, to = np.take_along_axis(rank, shift, 1), np.take_along_axis(to, shift, 1)
        for lo, has in ((at - 1, at > 0), (at, at < w - 2)):
            r, c = each[has], lo[has]
            rank[r, c], to[r, c] = pairs.ranks(ids[r, c], ids[r, c + 1])
    return out


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The same merges for one very long row, by a heap of (rank, place) over a linked list;
    each distinct pair is looked up in the table once."""
    ids = ids.tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def look(found: list[tuple[int, int]]) -> None:
        left, right = np.array(found, np.int64).T
        known.update(zip(found, zip(*(x.tolist() for x in pairs.ranks(left, right)))))

    look(list(set(zip(ids, ids[1:]))))
    none = int(NONE)
    heap = [(known[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if known[p][0] != none]
    heapq.heapify(heap)
    while heap:
        _, i, (a, b) = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = known[a, b][1], PAD
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < n:
                p = ids[x], ids[after[x]]
                if p not in known:
                    look([p])
                if known[p][0] != none:
                    heapq.heappush(heap, (known[p][0], x, p))
    return np.array([i for i in ids if i >= 0], np.int32)


def merge_words(ids: np.ndarray, lens: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of any lengths, given and returned as one flat array with lengths: rows
    of like length share a padded matrix."""
    starts = np.cumsum(lens) - lens
    bucket = np.searchsorted(_WIDTHS, lens)
    made, out_lens = [], np.zeros(len(lens), np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(len(_WIDTHS) + 2))
    for k, width in enumerate(_WIDTHS.tolist()):
        at = order[edges[k] : edges[k + 1]]
        step = max(64, 1_000_000 // width)
        for s in range(0, len(at), step):
            part = at[s : s + step]
            cols = np.arange(width)
            real = cols < lens[part][:, None]
            mat = np.full((len(part), width), PAD, np.int32)
            mat[real] = ids[(starts[part][:, None] + cols)[real]]
            mat = merge_matrix(mat, pairs)
            out_lens[part] = (mat >= 0).sum(1)
            made.append((part, mat))
    for i in order[edges[len(_WIDTHS)] :]:
        row = merge_long(ids[starts[i] : starts[i] + lens[i]], pairs)
        out_lens[i] = len(row)
        made.append((np.array([i]), row[None, :]))
    flat, begins = np.empty(out_lens.sum(), np.int32), np.cumsum(out_lens) - out_lens
    for part, mat in made:
        real = mat >= 0
        flat[(begins[part][:, None] + np.arange(mat.shape[1]))[real]] = mat[real]
    return flat, out_lens


class RankEncoder:
    """Byte-level BPE by a file of ranks (base64 token, rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, i in self.ids.items():
            for c in range(1, len(token)):
                if (a := self.ids.get(token[:c])) is not None and (b := self.ids.get(token[c:])) is not None:
                    left.append(a), right.append(b), merged.append(i)
        self.pairs = PairTable(left, right, merged, merged)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token itself is that token."""
        out: list = [self.ids.get(w) for w in words]
        todo = [w for w, x in zip(words, out) if x is None]
        lens = np.fromiter(map(len, todo), np.int64, len(todo))
        flat, lens = merge_words(self.first[np.frombuffer(b"".join(todo), np.uint8)], lens, self.pairs)
        flat, ends = flat.tolist(), np.cumsum(lens).tolist()
        made = iter(map(flat.__getitem__, map(slice, [0, *ends], ends)))
        return [next(made) if x is None else [x] for x in out]


class WordEndEncoder:
    """BPE with word ends, for lower-case pieces of letters or of other characters that the
    tokenizer file's pattern leaves whole."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        letter = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in letter], np.int32)
        self.last = np.array([vocab[c + end] for c in letter], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each non-empty piece, flat, and their counts."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[codes]
        ends = np.cumsum(lens) - 1
        ids[ends] = self.last[codes[ends]]
        return merge_words(ids, lens, self.pairs)
