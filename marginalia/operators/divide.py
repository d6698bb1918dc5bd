"""Division of texts into chunks: break points, greedy folds, pieces.

Each strategy is a column of pieces (start, end, kind) of a text; ``exploded`` makes rows. The
folds run inside the row, over arrays of positions, so a strategy needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.breaks import PIECE, Known, all_starts, blocks, cut_out, first_in, last_in, pieces, runs, sized, starts, weighted
from ..functions.text import INK, SPEAKERS, any_match, bound, transcript_like

# Patterns with strengths, and sizes, that define the results.
SENTENCE_END = r"[.!?]\s+"
TRANSITIONS = [
    r"(^|\n)\s*([A-Z][a-z]+ ?[A-Z]?[a-z]*):", r"(^|\n)\s*([A-Z][a-z]+ [A-Z][a-z]+):",
    r"(^|\n)\s*\d{1,2}:\d{2}(:\d{2})?\s*[AP]M\s*([A-Z][a-z]+ ?[A-Z]?[a-z]*):", r"(^|\n)\s*\d{1,2}:\d{2}(:\d{2})?\s*[AP]M\s*([A-Z][a-z]+ [A-Z][a-z]+):",
]
STRUCTURE = [
    (r"(^|\n)#{1,3}\s+[^\n]+", 0.9), (r"(^|\n)[A-Z][A-Z\s]+[A-Z]:\s*\n", 0.8), (r"(^|\n)[A-Z][A-Z\s]+[A-Z]\n", 0.8), (r"\n\s*\n", 0.7),
    (r"(^|\n)\s*\d+\.\s+", 0.6), (r"(^|\n)\s*[-*•]\s+", 0.6), (r"\n", 0.4),
]
TOPICS = [r"(?i)\n(?:Next|Now|Moving on to|Let's discuss|Let's talk about|Turning to|Regarding|About)", r"\n\s*\n", r"\n\s*\d+\.\s+", r"\n\s*[-*•]\s+", r"(?<=[.!?])\s+(?=[A-Z])"]
BOUNDARIES = [r"\n#{1,3}\s+", r"\n[A-Z][A-Z\s]+[A-Z]:", r"\n[A-Z][A-Z\s]+\n", r"\n\s*\n", r"\n\s*\d+\.\s+", r"\n\s*[-*•]\s+"]
CONTEXT = [
    (r"\n#{1,3}\s+[A-Za-z]", 0.9), (r"\n[A-Z][A-Z\s]+\n", 0.85), (r"\n\s*\n", 0.8), (r"\n\s*\d+\.\s+", 0.75), (r"\n\s*[-*•]\s+", 0.7),
    (r"(?i)(?:Next|Now|Moving on to|Let's discuss|Let's talk about|Turning to|Regarding|About)", 0.65),
    (r"\n[A-Z][a-z]+\s*[A-Z][a-z]*\s*:", 0.9), (r"\n[A-Z][a-z]+:", 0.85), (r"(?<=[.!?])\s+(?=[A-Z])", 0.5),
]
#: Patterns of the context that other strategies look for too.
COMMON = [p for p, _ in CONTEXT if p in BOUNDARIES or p in TOPICS]
TURN = r"(^|\n)(?:[A-Z][a-z]+ [A-Z][a-z]+|[A-Z][a-z]+|(?:Dr|Mr|Mrs|Ms)\. [A-Z][a-z]+):"
TEAMS_TURN = r"\d{1,2}:\d{2}:\d{2}\s+[AP]M\s+From\s+[^:]+:"
INTS = "array<int>"
STOPS, GAP = (". ", "! ", "? "), ("\n\n",)


def _ints(*x):
    return F.array(*x).cast(INTS)


def default_size(length: Column, min_chunks: int) -> Column:
    """Largest chunk if none is given: the even share and a fifth, 16000 at most."""
    return F.least(F.floor(F.floor(length / min_chunks) * 1.2), F.lit(16000)).cast("int")


def even(text: Column, length: Column, min_chunks: int, most: Column) -> Column:
    """Chunks that end at the sentence end nearest to the target size, within 30 % of it."""
    target = F.greatest(F.lit(1.0), F.least(most.cast("double"), length / min_chunks))

    def fold(ends: Column, t: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            aim = F.least(a["pos"] + t, length.cast("double"))
            near = F.filter(ends, lambda b: (b > a["pos"]) & (F.abs(b - aim) <= t * 0.3))
            best = F.array_min(F.transform(near, lambda b: F.struct(F.abs(b - aim).alias("d"), b.alias("b"))))["b"]
            end = F.coalesce(best, F.least(a["pos"] + F.floor(t).cast("int"), length))
            return F.when(a["pos"] >= length, a).otherwise(bound(end, lambda e: F.struct(e.alias("pos"), F.array_append(a["cuts"], e).alias("cuts"))))

        zero = F.struct(F.lit(0).alias("pos"), _ints().alias("cuts"))
        return F.aggregate(F.sequence(F.lit(1), (F.ceil(length / (t * 0.7)) + 3).cast("int")), zero, step, lambda a: F.filter(a["cuts"], lambda x: x < length))

    share = F.floor(length / min_chunks).cast("int")
    slices = F.when(F.lit(min_chunks) > 1, F.transform(F.sequence(F.lit(1), F.lit(max(1, min_chunks - 1))), lambda i: i * share)).otherwise(_ints())
    with_ends = bound(target, lambda t: bound(starts(text, SENTENCE_END, ends=True), lambda ends: F.when(F.size(ends) > 0, pieces(fold(ends, t), length, "sentence_boundary_segment"))))
    return F.coalesce(with_ends, pieces(slices, length, "even_segment"))


def structural(text: Column, length: Column, min_chunks: int, most: Column) -> Column:
    """Chunks that end at the best-scored structural break before they grow too large."""
    none = F.lit(None).cast("int")

    def state(s: Column, best: Column, score: Column, cuts: Column) -> Column:
        return F.struct(s.alias("s"), best.alias("best"), score.alias("score"), cuts.alias("cuts"))

    def cut_at(a: Column, e: Column, kind: Column) -> Column:
        return state(e, none, F.lit(0.0), F.array_append(a["cuts"], F.struct(e.alias("e"), kind.alias("kind"))))

    def fold(breaks: Column, most: Column, target: Column) -> Column:
        def scored(a: Column, pos: Column, strength: Column) -> Column:
            size = pos - a["s"]
            new = strength * F.greatest(F.lit(0.5), F.lit(1.0) - F.abs(size - target) / target)
            best = bound(new, lambda v: F.struct(F.when(v > a["score"], pos).otherwise(a["best"]).alias("at"), F.greatest(a["score"], v).alias("score")))
            whole = F.lit("structural_segment")
            return bound(best, lambda x: F.when((size >= target * 0.8) & (x["score"] > 0.6), cut_at(a, x["at"], whole)).otherwise(state(a["s"], x["at"], x["score"], a["cuts"])))

        def step(a: Column, b: Column) -> Column:
            pos = b["pos"]
            hard = F.when(a["best"].isNull(), "size_limited_segment").otherwise("structural_segment")
            closed = F.when(pos - a["s"] > most, cut_at(a, F.coalesce(a["best"], a["s"] + most), hard)).otherwise(a)
            return F.when(pos <= a["s"], a).otherwise(bound(closed, lambda x: scored(x, pos, b["strength"])))

        zero = F.struct(F.lit(0).alias("s"), F.lit(None).cast("int").alias("best"), F.lit(0.0).alias("score"), F.array().cast("array<struct<e:int,kind:string>>").alias("cuts"))
        return F.aggregate(breaks, zero, step, lambda a: a["cuts"])

    def made(cuts: Column) -> Column:
        closed = F.concat(cuts, F.array(F.struct(length.alias("e"), F.lit("structural_segment").alias("kind"))))
        rows = bound(closed, lambda c: F.transform(c, lambda x, i: F.struct(F.coalesce(F.get(c, i - 1)["e"], F.lit(0)).alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
        return F.filter(rows, lambda x: x["e"] > x["s"]).cast(PIECE)

    late = frozenset([r"\n\s*\n", r"\n"])
    return bound(weighted(text, STRUCTURE, late), lambda b: F.when(F.size(b) > 0, bound(bound(F.struct(most.alias("most"), (length / min_chunks).alias("target")), lambda z: fold(b, z["most"], z["target"])), made)).otherwise(even(text, length, min_chunks, most)))


def by_turns(text: Column, length: Column, min_chunks: int, most: Column) -> Column:
    """Chunks that end at speaker transitions; few transitions fall back to structure."""

    def fold(turns: Column) -> Column:
        n = F.size(turns)
        target = length / F.greatest(F.lit(min_chunks), F.least(F.floor(n / 10).cast("int"), F.lit(20)))

        def run(t: Column) -> Column:
            def step(a: Column, pos: Column) -> Column:
                size = a["size"] + pos - a["s"]
                cut = F.struct(pos.alias("s"), F.lit(0).alias("size"), F.array_append(a["cuts"], pos).alias("cuts"))
                go = F.struct(a["s"].alias("s"), size.alias("size"), a["cuts"].alias("cuts"))
                return F.when(pos == 0, a).when((size > most) | (size >= t * 0.8), cut).otherwise(go)

            zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("size"), _ints().alias("cuts"))
            return F.aggregate(turns, zero, step, lambda a: a["cuts"])

        return bound(target, run)

    some = lambda t: F.when(F.size(t) >= 3 * min_chunks, pieces(fold(t), length, "transcript_segment")).otherwise(structural(text, length, min_chunks, most))
    return bound(all_starts(text, TRANSITIONS), some)


def chunked(text: Column, min_chunks: int = 3, most: int | None = None) -> Column:
    """The whole rule: one chunk where it fits, by turns or structure, even if too few."""

    def rule(text: Column, length: Column) -> Column:
        size = F.lit(most) if most else default_size(length, min_chunks)
        whole = F.array(F.struct(F.lit(0).alias("s"), length.alias("e"), F.lit("full_document").alias("kind"))).cast(PIECE)
        smart = F.when(transcript_like(text), by_turns(text, length, min_chunks, size)).otherwise(structural(text, length, min_chunks, size))
        enough = bound(smart, lambda p: F.when(F.size(p) >= min_chunks, p).otherwise(even(text, length, min_chunks, size)))
        return F.when((length <= size) & (F.lit(min_chunks) <= 1), whole).otherwise(enough)

    return sized(text, rule)


def exploded(docs: DataFrame, column: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of pieces: index, start, end, kind, text. Wide text work stays in its partition; the pieces' texts
    are cut out of blocks in the row, so that no row carries the whole text."""
    whole = lambda parts: F.transform(column, lambda p: F.struct(p["s"].alias("start_pos"), p["e"].alias("end_pos"), p["kind"].alias("chunk_type"), cut_out(parts, p["s"], p["e"]).alias("text")))
    rows = docs.select(*keep, F.posexplode_outer(bound(blocks(F.col("text")), whole)).alias("chunk_index", "p")).where("p is not null")
    return rows.select(*keep, "chunk_index", "p.*")


def position_labels(chunks: DataFrame, doc: str = "doc_id", index: str = "chunk_index") -> DataFrame:
    """Add ``position``: introduction, early, middle, late, conclusion by place and count."""
    n, i = F.count(F.lit(1)).over(W.Window.partitionBy(doc)), F.col(index)
    early = F.greatest(F.lit(1), F.floor(n / 4))
    late = F.greatest(n - early - 1, F.floor(3 * n / 4))
    label = F.when(n == 1, "full_document").when(i == 0, "introduction").when(i == n - 1, "conclusion").when(n <= 4, "middle").when(i < early, "early").when(i >= late, "late").otherwise("middle")
    return chunks.withColumn("position", label)


def place(i: Column, n: Column, first: str, last: str, lo: float, hi: float) -> Column:
    """Label by relative place: first, last, early below ``lo``, late above ``hi``, middle."""
    return F.when(i == 0, first).when(i == n - 1, last).when(i / n < lo, "early").when(i / n > hi, "late").otherwise("middle")


def sections_of(length: Column, least: int, tokens: int) -> Column:
    return F.greatest(F.lit(least), F.ceil(length / 4 / tokens).cast("int"))


def essential(text: Column, length: Column, least: int = 1, tokens: int = 25000) -> Column:
    """Equal sections whose edges snap to a near paragraph or else sentence break."""
    return bound(blocks(text), lambda x: _essential(x, length, sections_of(length, least, tokens)))


def _essential(text: Column, length: Column, n: Column) -> Column:
    def snapped(i: Column, at: Column) -> Column:
        p = last_in(text, GAP, at - 500, at + 500)
        near = lambda p: F.when((p >= 0) & (F.abs(p - at) < 500), p + 2)
        mark = last_in(text, STOPS, at - 200, at + 200)
        other = lambda s: F.when((s >= 0) & (F.abs(s - at) < 200), s + 2).otherwise(at)
        return F.when((i > 0) & (at > 0), F.coalesce(bound(p, near), bound(mark, other))).otherwise(at)

    def closed(i: Column, at: Column) -> Column:
        p = first_in(text, GAP, at - 500, at + 500)
        near = lambda p: F.when((p >= 0) & (F.abs(p - at) < 500), p)
        mark = first_in(text, STOPS, at - 200, at + 200)
        other = lambda s: F.when((s >= 0) & (F.abs(s - at) < 200), s + 2).otherwise(at)
        return F.when((i < n - 1) & (at < length), F.coalesce(bound(p, near), bound(mark, other))).otherwise(at)

    def section(i: Column) -> Column:
        start, end = F.floor(i * (length / n)).cast("int"), F.least(length, F.floor((i + 1) * (length / n)).cast("int"))
        return F.struct(bound(start, lambda x: snapped(i, x)).alias("s"), bound(end, lambda x: closed(i, x)).alias("e"), F.lit("essential").alias("kind"))

    made = F.transform(F.sequence(F.lit(0), n - 1), section)
    return F.filter(made, lambda x: F.regexp_like(cut_out(text, x["s"], x["e"]), F.lit(INK))).cast(PIECE)


def nearest(breaks: Column, length: Column, sections: Column) -> Column:
    """For each ideal edge the closest break that is left; breaks near a chosen one go."""
    ideal = length / sections

    def step(a: Column, i: Column) -> Column:
        aim = F.floor(i * ideal).cast("int")
        best = F.array_min(F.transform(a["rest"], lambda b: F.struct(F.abs(b - aim).alias("d"), b.alias("b"))))["b"]
        made = lambda x: F.struct(F.filter(a["rest"], lambda b: F.abs(b - x) > ideal * 0.3).alias("rest"), F.array_append(a["out"], x).alias("out"))
        return F.when(F.size(a["rest"]) == 0, a).otherwise(bound(best, made))

    zero = F.struct(breaks.cast(INTS).alias("rest"), _ints().alias("out"))
    chosen = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), sections - 1)), zero, step, lambda a: F.sort_array(F.array_distinct(a["out"])))
    return F.when(sections <= 1, _ints()).when(F.size(breaks) <= sections - 1, F.array_distinct(breaks)).otherwise(chosen)


def by_speakers(text: Column, length: Column, least: int = 2, tokens: int = 25000) -> Column:
    """Turns packed up to a fifth over the target; text before the first turn belongs to it."""
    target = length / sections_of(length, least, tokens)

    def fold(turns: Column, t: Column) -> Column:
        def step(a: Column, pos: Column) -> Column:  # pos: where the next turn begins
            full = (pos - a["s"] > t * 1.2) & (a["upto"] > a["s"])
            s = F.when(full, a["upto"]).otherwise(a["s"])
            return F.struct(s.alias("s"), pos.alias("upto"), F.when(full, F.array_append(a["cuts"], a["upto"])).otherwise(a["cuts"]).alias("cuts"))

        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("upto"), _ints().alias("cuts"))
        return F.aggregate(F.concat(F.slice(turns, 2, F.greatest(F.lit(0), F.size(turns) - 1)), F.array(length)), zero, step, lambda a: a["cuts"])

    return bound(target, lambda t: bound(starts(text, TURN), lambda turns: pieces(F.when(F.size(turns) > 0, fold(turns, t)).otherwise(_ints()), length, "long")))


def by_topics(text: Column, length: Column, least: int = 2, tokens: int = 25000, known: Known | None = None) -> Column:
    n = sections_of(length, least, tokens)
    return bound(all_starts(text, TOPICS, known), lambda b: F.when(F.size(b) < least - 1, essential(text, length, least, tokens)).otherwise(pieces(F.filter(nearest(b, length, n), lambda x: x > 0), length, "long")))


def long_(text: Column, length: Column, least: int = 2, tokens: int = 25000, known: Known | None = None) -> Column:
    return F.when(any_match(text, SPEAKERS), by_speakers(text, length, least, tokens)).otherwise(by_topics(text, length, least, tokens, known))


def by_structure(text: Column, length: Column, least: int = 2, tokens: int = 25000, known: Known | None = None) -> Column:
    """Intervals between boundaries of 200 characters or more, merged while there are too many."""
    n = sections_of(length, least, tokens)

    def merged(rows: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            fits = (a["e"] - a["s"]) + (x["e"] - x["s"]) < (length / n) * 1.5
            first = a["s"].isNull()
            return F.struct(
                F.when(first | ~fits, x["s"]).otherwise(a["s"]).alias("s"), x["e"].alias("e"),
                F.when(first | fits, a["out"]).otherwise(F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e"), F.lit("complex").alias("kind")))).alias("out"),
            )

        none = F.lit(None).cast("int")
        zero = F.struct(none.alias("s"), none.alias("e"), F.array().cast(PIECE).alias("out"))
        close = lambda a: F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e"), F.lit("complex").alias("kind")))
        return F.aggregate(rows, zero, step, close)

    def run(b: Column) -> Column:
        rows = F.filter(pieces(b, length, "complex"), lambda x: x["e"] - x["s"] >= 200)
        return bound(rows, lambda r: F.when(F.size(r) > 2 * n, merged(r)).otherwise(r))

    return bound(all_starts(text, BOUNDARIES, known), lambda b: F.when(F.size(b) > 0, run(b)).otherwise(F.array().cast(PIECE)))


def context_aware(text: Column, length: Column, least: int = 2, tokens: int = 25000, known: Known | None = None) -> Column:
    """Greedy sections that end at the break of most adjusted strength near the target size."""
    n = sections_of(length, least, tokens)

    def fold(grouped: Column, t: Column, parts: Column) -> Column:
        small = F.greatest(F.lit(1000.0), F.floor(t / 3))
        back = F.floor(t * 0.2).cast("int")

        def step(a: Column, _: Column) -> Column:
            s = a["s"]
            # runs up to the one that holds the first break beyond the reach
            some = F.flatten(F.transform(F.filter(grouped, lambda r: (r["last"] >= s + F.least(small, t * 1.5)) & (r["before"] <= s + t * 1.5)), lambda r: r["rows"]))

            def reached(some: Column) -> Column:
                stop = F.coalesce(F.array_min(F.transform(F.filter(some, lambda b: b["pos"] > s + t * 1.5), lambda b: b["i"])), F.lit(2**31 - 1))
                return bound(stop, lambda z: F.filter(some, lambda b: (b["pos"] - s >= small) & (b["pos"] > s) & (b["i"] <= z)))

            def scored(b: Column) -> Column:
                size = b["pos"] - s
                factor = F.when(size.between(t * 0.8, t * 1.2), 1.2).when(size < t * 0.5, 0.8).when(size > t * 1.5, 0.7).otherwise(1.0)
                return F.struct((b["strength"] * factor).alias("v"), (-b["i"]).alias("o"), b["pos"].alias("pos"))

            best = F.array_max(F.transform(bound(some, reached), scored))["pos"]
            hard = F.least(s + F.floor(t).cast("int"), length)
            snapped = bound(last_in(parts, STOPS, hard - back, hard), lambda end: F.when((hard < length) & (end >= 0) & (end + 2 > s), end + 2).otherwise(hard))
            nxt = F.coalesce(best, snapped)
            return F.when(s >= length, a).otherwise(bound(nxt, lambda x: F.struct(x.alias("s"), F.array_append(a["cuts"], x).alias("cuts"))))

        zero = F.struct(F.lit(0).alias("s"), _ints().alias("cuts"))
        steps = (F.ceil(length / F.greatest(F.lit(1.0), F.least(t * 0.75, small))) + 3).cast("int")
        return F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda a: F.filter(a["cuts"], lambda x: x < length))

    def kept(parts: Column) -> Column:
        edges = lambda r: F.struct(r.alias("rows"), F.element_at(r, -1)["pos"].alias("last"))
        after = lambda e: F.transform(e, lambda r, i: F.struct(r["rows"].alias("rows"), r["last"].alias("last"), F.coalesce(F.get(e, i - 1)["last"], F.lit(-1)).alias("before")))
        grouped = lambda b: bound(F.transform(runs(b), edges), after)
        run = lambda b: bound(F.struct(F.greatest(F.lit(1.0), length / n).alias("t"), grouped(b).alias("r")), lambda z: pieces(fold(z["r"], z["t"], parts), length, "complex"))
        made = bound(weighted(text, CONTEXT, known=known), lambda b: F.when(F.size(b) > 0, run(b)).otherwise(_essential(parts, length, n)))
        return F.filter(made, lambda x: F.regexp_like(cut_out(parts, x["s"], x["e"]), F.lit(r"\S")))

    return bound(blocks(text), kept)


def complex_(text: Column, length: Column, least: int = 2, tokens: int = 25000, known: Known | None = None) -> Column:
    """Of structure and context the division whose count is closest to the target."""
    target = F.greatest(F.lit(least), F.floor(length / (tokens * 4)).cast("int"))

    def pick(a: Column, b: Column) -> Column:
        ok_a, ok_b = F.size(a) >= least, F.size(b) >= least
        closer = F.abs(F.size(a) - target) <= F.abs(F.size(b) - target)
        return F.when(ok_a & (~ok_b | closer), a).when(ok_b, b).otherwise(essential(text, length, least, tokens))

    return bound(by_structure(text, length, least, tokens, known), lambda a: bound(context_aware(text, length, least, tokens, known), lambda b: pick(a, b)))


ALIASES = {"basic": "essential", "speaker": "long", "boundary": "complex", "context_aware": "complex", "semantic": "complex"}


def divided(text: Column, strategy: Column, least: int = 1, tokens: int = 25000) -> Column:
    """Pieces by a strategy column; unknown names are essential, auto is by assessment."""
    from ..functions.text import assessment

    name = F.when(strategy == "auto", assessment(text)["recommended_strategy"]).otherwise(strategy)
    two = max(2, least)
    rule = lambda t, n: F.when(name == "long", long_(t, n, two, tokens)).when(name == "complex", complex_(t, n, two, tokens)).otherwise(essential(t, n, least, tokens))
    return sized(text, rule)


def teams(text: Column, length: Column, most: int) -> Column:
    """Turns packed until a chunk passes ``most``; short texts stay whole."""

    def fold(turns: Column) -> Column:
        def step(a: Column, pos: Column) -> Column:
            full = pos - a["s"] > most
            return F.struct(F.when(full, pos).otherwise(a["s"]).alias("s"), F.when(full, F.array_append(a["cuts"], pos)).otherwise(a["cuts"]).alias("cuts"))

        zero = F.struct(F.lit(0).alias("s"), _ints().alias("cuts"))
        return F.aggregate(F.slice(turns, 2, F.greatest(F.lit(0), F.size(turns) - 1)), zero, step, lambda a: a["cuts"])

    cut = bound(starts(text, TEAMS_TURN), lambda t: F.when(F.size(t) > 0, pieces(fold(t), length, "teams")).otherwise(by_size(text, length, most)))
    return F.when(length < 0.8 * most, pieces(_ints(), length, "teams")).otherwise(cut)


def by_size(text: Column, length: Column, most: int) -> Column:
    """About equal parts, each closed at the last paragraph or else sentence break in reach."""
    target = F.greatest(F.lit(1), F.floor(length / F.ceil(length / most)).cast("int"))

    def fold(t: Column, parts: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            s = a["s"]
            aim = F.least(s + t, length)
            after = lambda part, reach: bound(last_in(parts, part, s, aim + reach), lambda p: F.when(p >= 0, p + 2))
            end = F.when(aim >= length, aim).otherwise(F.coalesce(after(GAP, 500), after(STOPS, 200), aim))
            return F.when(s >= length, a).otherwise(bound(end, lambda e: F.struct(e.alias("s"), F.array_append(a["cuts"], e).alias("cuts"))))

        zero = F.struct(F.lit(0).alias("s"), _ints().alias("cuts"))
        # a paragraph or sentence that ends early may leave a short part: as many steps as breaks allow
        steps = F.least(length, F.ceil(length / t).cast("int") * 4 + F.size(F.split(text, "\n\n")) + F.size(F.split(text, r"[.!?] ")))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps)), zero, step, lambda a: F.filter(a["cuts"], lambda x: x < length))

    return F.when(length <= most, pieces(_ints(), length, "size")).otherwise(bound(target, lambda t: bound(blocks(text), lambda x: pieces(fold(t, x), length, "size"))))


def paragraphs(text: Column, most: int = 1000) -> Column:
    """Trimmed non-blank paragraphs; larger ones re-packed from sentences up to ``most``."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def packed(p: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            full = (a["size"] + F.length(s) > most) & (F.size(a["now"]) > 0)
            return F.struct(
                F.when(full, F.array(s)).otherwise(F.array_append(a["now"], s)).alias("now"), F.when(full, F.length(s)).otherwise(a["size"] + F.length(s)).alias("size"),
                F.when(full, F.array_append(a["out"], F.array_join(a["now"], " "))).otherwise(a["out"]).alias("out"),
            )

        none = F.array().cast("array<string>")
        zero = F.struct(none.alias("now"), F.lit(0).alias("size"), none.alias("out"))
        return F.aggregate(F.split(p, r"(?<=[.!?])\s+"), zero, step, lambda a: F.array_append(a["out"], F.array_join(a["now"], " ")))

    found = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    return F.flatten(F.transform(found, lambda p: F.when(F.length(p) > most, packed(p)).otherwise(F.array(p))))


def adjacent_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of each paragraph's vector and the next one's."""
    nxt = F.lead("embedding").over(W.Window.partitionBy("doc_id").orderBy("para_index"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    rows = vectors.withColumn("nxt", nxt).where("nxt is not null")
    return rows.select("doc_id", "para_index", (dot(F.col("embedding"), F.col("nxt")) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("nxt"), F.col("nxt"))))).alias("similarity"))


def topic_boundaries(similarities: DataFrame, least: int = 2) -> DataFrame:
    """Paragraphs that begin a section: the largest drops below the local mean, and the end."""
    doc = W.Window.partitionBy("doc_id")
    near = doc.orderBy("para_index").rowsBetween(-1, 1)
    rows = similarities.withColumns({"n": F.count(F.lit(1)).over(doc) + 1, "drop": F.greatest(F.lit(0.0), F.avg("similarity").over(near) - F.col("similarity"))})
    inner = rows.where("para_index > 0 and para_index < n - 2")
    wanted = F.greatest(F.lit(least), F.least(F.floor(F.col("n") / 5).cast("int"), F.lit(10))) - 1
    top = inner.withColumn("k", F.row_number().over(doc.orderBy(F.desc(F.round("drop", 12)), "para_index"))).where(F.col("k") <= wanted)
    return top.select("doc_id", (F.col("para_index") + 1).cast("int").alias("boundary")).union(rows.select("doc_id", F.col("n").cast("int")).distinct())


def semantic_sections(paras: DataFrame, boundaries: DataFrame, tokens: int = 25000) -> DataFrame:
    """Paragraphs (doc_id, para_index, text) with section and subsection: sections begin at
    boundaries; those of over 1.2 times ``tokens`` and three paragraphs are packed anew."""
    ends = boundaries.groupBy("doc_id").agg(F.array_sort(F.collect_set("boundary")).alias("ends"))  # one an edge of a document
    rows = paras.join(ends, "doc_id").withColumn("section", F.size(F.filter("ends", lambda b: b <= F.col("para_index"))))
    rows = rows.withColumn("tokens", F.floor(F.length("text") / 4).cast("int"))

    def step(a: Column, x: Column) -> Column:
        full = (a["size"] + x["t"] > tokens) & (a["size"] > 0)
        sub = F.when(full, a["sub"] + 1).otherwise(a["sub"])
        return F.struct(F.when(full, x["t"]).otherwise(a["size"] + x["t"]).alias("size"), sub.alias("sub"), F.array_append(a["out"], F.struct(x["i"].alias("i"), sub.alias("sub"))).alias("out"))

    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("sub"), F.array().cast("array<struct<i:int,sub:int>>").alias("out"))
    g = rows.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct(F.col("para_index").alias("i"), F.col("tokens").alias("t")))).alias("x"), F.sum("tokens").alias("all"))
    same = F.transform("x", lambda x: F.struct(x["i"].alias("i"), F.lit(0).alias("sub")))
    g = g.select("doc_id", "section", F.inline(F.when((F.col("all") > tokens * 1.2) & (F.size("x") > 3), F.aggregate("x", zero, step, lambda a: a["out"])).otherwise(same)))
    return g.select("doc_id", F.col("i").alias("para_index"), "section", F.col("sub").alias("subsection"))
