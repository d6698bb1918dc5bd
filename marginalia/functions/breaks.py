"""Break positions of texts and the arrays of pieces that cuts at them give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import all_matches, bound

PIECE = "array<struct<s:int,e:int,kind:string>>"


#: Entries of a run of positions: what a fold adds one by one, since every addition copies the array.
RUN = 32


def runs(rows: Column) -> Column:
    """An array in arrays of ``RUN`` entries; none of an empty one."""
    last = F.floor((F.size(rows) - 1) / RUN).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * RUN + 1, RUN))).otherwise(F.slice(F.array(rows), 1, 0))


def starts(text: Column, pattern: str, ends: bool = False) -> Column:
    """Start (or end) positions of all matches: lengths of what lies between and of matches,
    summed up in one pass, run by run."""
    none = F.array().cast("array<int>")

    def run(parts: Column, found: Column) -> Column:
        sizes = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        step = lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.array_append(a["out"], a["at"] + x["p"] + (x["m"] if ends else F.lit(0))).alias("out"))
        some = lambda a, r: F.aggregate(r, F.struct(a["at"].alias("at"), none.alias("out")), step)
        more = lambda a, r: bound(some(a, r), lambda x: F.struct(x["at"].alias("at"), F.array_append(a["out"], x["out"]).alias("out")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return bound(sizes, lambda rows: F.aggregate(runs(rows), zero, more, lambda a: F.flatten(a["out"])))

    return bound(all_matches(text, pattern), lambda m: F.when(F.size(m) > 0, run(F.split(text, pattern), m)).otherwise(none))


#: Starts of patterns that are found already.
Known = dict[str, Column]


def with_starts(docs: DataFrame, patterns: list[str]) -> tuple[DataFrame, Known]:
    """Documents with the starts of patterns that several rules ask for, as columns, each looked for once."""
    names = {p: f"starts_{i}" for i, p in enumerate(patterns)}
    return docs.select("*", *[starts(F.col("text"), p).alias(n) for p, n in names.items()]), {p: F.col(n) for p, n in names.items()}


def _known(text: Column, pattern: str, known: Known | None) -> Column:
    return known[pattern] if known and pattern in known else starts(text, pattern)


def all_starts(text: Column, patterns: list[str], known: Known | None = None) -> Column:
    """Sorted starts of several patterns, repeats kept."""
    return F.sort_array(F.flatten(F.array(*[_known(text, p, known) for p in patterns])))


def _tagged(at: Column, k: int, strength: float) -> Column:
    return F.transform(at, lambda x: F.struct(x.alias("pos"), F.lit(k).alias("k"), F.lit(strength).cast("double").alias("strength")))


def sized(text: Column, f) -> Column:
    """``f(text, length)`` with the length counted once: lambdas would count it a time each."""
    return bound(F.length(text), lambda n: f(text, n))


def weighted(text: Column, patterns: list[tuple[str, float]], late: frozenset = frozenset(), known: Known | None = None) -> Column:
    """Sorted (pos, k, strength, i) of weighted patterns; those in ``late`` count from 11 on."""
    found = []
    for k, (p, strength) in enumerate(patterns):
        at = _known(text, p, known)
        if p in late:
            at = F.filter(at, lambda x: x > 10)
        found.append(_tagged(at, k, strength))
    return F.transform(F.sort_array(F.flatten(F.array(*found))), lambda x, i: F.struct(x["pos"].alias("pos"), x["k"].alias("k"), x["strength"].alias("strength"), i.alias("i")))


def pieces(cuts: Column, length: Column, kind: str) -> Column:
    """Pieces between inner cuts (sorted), over the whole text; empty pieces dropped."""
    edges = lambda c: F.concat(F.array(F.lit(0)), c, F.array(length))
    made = bound(edges(cuts), lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.struct(x.alias("s"), F.get(c, i + 1).alias("e"), F.lit(kind).alias("kind"))))
    return F.filter(made, lambda x: x["e"] > x["s"]).cast(PIECE)


#: Characters of a block: 2 ** BITS.
BITS = 12


def blocks(text: Column) -> Column:
    """A text in blocks of 2 ** BITS characters, out of which ``cut_out`` takes parts without reading the text from its start."""
    return all_matches(text, "(?s).{1,%d}" % 2**BITS)


def cut_out(parts: Column, s: Column, e: Column) -> Column:
    """Characters [s, e) of the text of these blocks, s at least 0; empty where e is not above s."""
    first = F.shiftright(s, BITS)
    found = F.slice(parts, first + 1, F.shiftright(F.greatest(e - 1, s), BITS) - first + 1)
    return F.substr(F.array_join(found, ""), s - F.shiftleft(first, BITS) + 1, F.greatest(F.lit(0), e - s))


def last_in(text: Column, parts: tuple[str, ...], lo: Column, hi: Column) -> Column:
    """Position of the last occurrence of any of the parts, all of one length, that lies within [lo, hi); -1 without
    one. ``text`` is in blocks; the window is cut out once."""
    lo, size = F.greatest(F.lit(0), lo), len(parts[0])
    before = lambda back, part: F.locate(part[::-1], back)

    def at(back: Column) -> Column:
        found = F.array_min(F.filter(F.array(*[before(back, x) for x in parts]), lambda f: f > 0))
        return bound(found, lambda f: F.coalesce(lo + F.length(back) - (f - 1) - size, F.lit(-1)))

    return bound(F.reverse(cut_out(text, lo, hi)), at)


def first_in(text: Column, parts: tuple[str, ...], lo: Column, hi: Column) -> Column:
    """Largest of the first positions of each part within [lo, hi), -1 for a part without one; ``text`` is in blocks."""
    lo = F.greatest(F.lit(0), lo)
    return bound(cut_out(text, lo, hi), lambda w: bound(F.array_max(F.array(*[F.locate(x, w) for x in parts])), lambda f: F.when(f > 0, lo + f - 1).otherwise(F.lit(-1))))
