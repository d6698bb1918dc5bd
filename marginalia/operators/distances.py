"""Edit distances of many pairs of texts side by side, each with a bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WORD = 64  # cells of a column in one number
FEW = 16  # below so many pairs of like lengths one by one is faster
WIDE = 800_000  # letters of the longer texts of a part
PLACES = 4_000_000  # numbers of the table of places
CHECK = 16  # columns between two looks at what is out of reach
_ALL, _ONE, _TOP = np.uint64(2**WORD - 1), np.uint64(1), np.uint64(WORD - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, int]:
    """Letters of all texts, one after the other, as numbers from 0, and how many there are."""
    kinds, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    return codes.astype(np.int64), len(kinds)


def _offsets(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all letters of texts of these lengths, one after the other: number of the text, place in it."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _bare(x: str, y: str) -> tuple[str, str]:
    """Texts, x not the longer, without what they begin and end with in common."""
    a, end = 0, len(x)
    while a < end and x[a] == y[a]:
        a += 1
    b = 0
    while b < end - a and x[-1 - b] == y[-1 - b]:
        b += 1
    return (x[a : end - b], y[a : len(y) - b]) if a or b else (x, y)


def _side_by_side(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray | None:
    """Distances of pairs (x, y), x not longer than y; over ``most`` -1 or any number above; None if
    they hold too many different letters for one table.

    A column of the matrix is words of 64 cells. In step s word w is at column s - w, so that all words of all pairs take a step
    at once, each with the carries that the word above left a step before. Both texts get one letter more at their ends as often as
    it takes for all y to be of one length. Only words near enough to the diagonals are kept: from a cell, at least its distance to the diagonal of
    the end is still to come. This sum falls neither along a diagonal nor away from that of the end, so what is out of
    reach for all pairs stays so, and a pair is out when its cell on that diagonal is. What words left out would have
    given is taken too high, never too low.
    """
    size, columns = len(pairs), max(len(y) for _, y in pairs)
    m, n = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    codes, kinds = _codes([x for x, _ in pairs] + [y for _, y in pairs])
    end_row = m + columns - n
    width, gap, cut = -(-int(end_row.max()) // WORD), n - m, int(m.sum())
    table = (kinds + 1) * size  # a word's places of letters, by letter and pair; the last letter is the one added
    if width * table > PLACES:
        return None
    where = np.zeros(width * table, np.uint64)
    text, place = _offsets(m)
    more, beyond = _offsets(columns - n)
    text, place = np.concatenate([text, more]), np.concatenate([place, beyond + m[more]])
    letter = np.concatenate([codes[:cut], np.full(len(more), kinds)])
    np.bitwise_or.at(where, (place >> 6) * table + letter * size + text, _ONE << (place & 63).astype(np.uint64))
    y = np.empty((columns, size), np.int64)
    y[:] = kinds * size + np.arange(size)
    text, place = _offsets(n)
    y[place, text] = codes[cut:] * size + text
    start = (np.arange(width) * table)[:, None]
    edge = (np.arange(1, width + 1) * WORD)[:, None]
    above, below = int(((most + gap) // 2).max()), int(((most - gap) // 2).max())  # diagonals beyond are out of reach
    up, down = np.full((width, size), _ALL), np.zeros((width, size), np.uint64)  # cells one more, one less than the cell above
    score = np.zeros((width, size), np.int64)  # cells at the words' ends
    more, less = np.zeros((width + 1, size), np.uint64), np.zeros((width + 1, size), np.uint64)  # steps to the right at the words' beginnings
    space, at_, own, out = np.empty((5, width, size), np.uint64), np.empty((width, size), np.int64), np.arange(size), np.full(size, -1, np.int64)
    end_word, least, top, first, last = (end_row - 1) // WORD, int(most.min()), 0, 0, 0
    for s in range(columns + width - 1):
        while top + 1 < width and (top + 1) * WORD < s - top + 1 - above:
            top += 1
        first = max(top, s - columns + 1)
        now = max(first + 1, min(width, s + 1, (s + 1 + below) // (WORD + 1) + 1))
        for w in range(last, now):
            up[w], down[w] = _ALL, 0
            score[w] = WORD if not w else score[w - 1] - more[w].astype(np.int64) + less[w].astype(np.int64) + WORD
        last = now
        if first == top:  # above is the matrix's first row, or what is out of reach
            more[first], less[first] = 1, 0
        k = slice(first, last)
        p, q, plus, minus, at = up[k], down[k], more[k], less[k], at_[k]
        same, level, right, left, over = (x[k] for x in space)
        np.add(y[s - last + 1 : s - first + 1][::-1], start[k], out=at)
        np.take(where, at, out=same, mode="clip")
        np.bitwise_or(same, q, out=level)
        np.bitwise_or(same, minus, out=same)
        np.bitwise_and(same, p, out=left)
        np.add(left, p, out=left)
        np.bitwise_xor(left, p, out=left)
        np.bitwise_or(left, same, out=left)
        np.bitwise_or(left, p, out=right)
        np.invert(right, out=right)
        np.bitwise_or(right, q, out=right)
        np.bitwise_and(left, p, out=left)
        np.right_shift(right, _TOP, out=over)
        np.right_shift(left, _TOP, out=same)
        np.left_shift(right, _ONE, out=right)
        np.left_shift(left, _ONE, out=left)
        np.bitwise_or(right, plus, out=right)
        np.bitwise_or(left, minus, out=left)
        np.bitwise_or(level, right, out=p)
        np.invert(p, out=p)
        np.bitwise_or(p, left, out=p)
        np.bitwise_and(right, level, out=q)
        more[first + 1 : last + 1], less[first + 1 : last + 1] = over, same
        score[k] += over.view(np.int64)
        score[k] -= same.view(np.int64)
        if s - first == columns - 1:
            here = np.nonzero(end_word == first)[0]
            bits = (end_row[here] - first * WORD).astype(np.uint64)  # 1 to 64
            rest = np.where(bits == WORD, np.uint64(0), _ALL << np.minimum(bits, _TOP))
            tail = np.bitwise_count(up[first, here] & rest).astype(np.int64) - np.bitwise_count(down[first, here] & rest)
            out[own[here]] = score[first, here] - tail
        if s % CHECK or s <= least or s >= columns:
            continue
        goal = (s + 1 - np.arange(first, last))[:, None] - gap - edge[k]  # rows from a word's end to the diagonal of the end
        np.abs(goal, out=at)
        keep = np.nonzero((score[k] - at <= most).all(axis=0))[0]
        if len(keep) < 0.85 * len(own):
            if not len(keep):
                break
            up, down, y, score, more, less = (x[:, keep] for x in (up, down, y, score, more, less))
            most, gap, own, goal, end_row, end_word = most[keep], gap[keep], own[keep], goal[:, keep], end_row[keep], end_word[keep]
            space, at_, least = np.empty((5, width, len(keep)), np.uint64), np.empty((width, len(keep)), np.int64), int(most.min())
        dead = (score[k] + np.abs(goal) > most).all(axis=1)
        for w in np.nonzero(dead & (goal >= 0).all(axis=1))[0] + first:
            above = min(above, s - int(w) - int(edge[w, 0]))
        for w in np.nonzero(dead & (goal <= 0).all(axis=1))[0] + first:
            below = min(below, int(edge[w, 0]) - s + int(w) - 2)
    return out


def distances(pairs: list[tuple[str, str]], most: np.ndarray, one: Callable[[str, str, int], int | None]) -> np.ndarray:
    """Edit distances of pairs, -1 where over ``most``. Pairs of like lengths are measured side by side; ``one`` measures
    pairs of which there are few, and very long ones."""
    out = np.full(len(pairs), -1, np.int64)
    short = [_bare(x, y) if len(x) <= len(y) else _bare(y, x) for x, y in pairs]
    m, n = (np.array([len(p[k]) for p in short], np.int64) for k in (0, 1))
    out[(m == 0) & (n <= most)] = n[(m == 0) & (n <= most)]
    todo = np.nonzero((m > 0) & (n - m <= most))[0]
    kind = np.floor(np.log(np.maximum(n, 1)) / np.log(1.12)).astype(np.int64)  # lengths of a part differ by about a tenth
    share = np.floor(4 * m / np.maximum(n, 1)).astype(np.int64)
    todo = todo[np.lexsort((m[todo], share[todo], kind[todo]))]
    for part in np.split(todo, np.nonzero(np.diff(kind[todo]) | np.diff(share[todo]))[0] + 1):
        longest = max(int(n[part].max(initial=1)), 1)
        room = max(WIDE // longest, min(64, 4 * WIDE // longest), 1)
        left = np.split(part, range(room, len(part), room))
        while left:
            some = left.pop()
            found = _side_by_side([short[i] for i in some], most[some]) if len(some) >= FEW else None
            if found is not None:
                out[some] = np.where(found <= most[some], found, -1)
            elif len(some) >= 2 * FEW:
                left += np.array_split(some, 2)
            else:
                for i in some:
                    d = one(*short[i], int(most[i]))
                    out[i] = -1 if d is None else d
    return out
