"""Token counts: overlapping chunks of huge documents, spliced where both encodings agree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import stable_units
from .common import Units, map_rows

CHUNK, OVERLAP, HUGE = 16_384, 256, 32_768
#: A chunk's last characters may be cut tokens or a cut special string; none is longer.
EDGE = 64
_loaded: dict[str, tuple] = {}
_boundary = re.compile(r"(?<=\S)(?=[ \n])")


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path), Units()
    return _loaded[path]


def _encode(tokenizer, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    made = tokenizer.encode(text, add_special_tokens=False)
    return made.ids, made.offsets


def splice_ids(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE) -> list[int]:
    """Ids of a whole text from overlapping chunks.

    A place between a non-space and a space or line feed ends a pattern match whatever its
    surroundings, so what follows it is encoded alike in every chunk that holds it. The left
    chunk is kept up to such a place p in the overlap, the right one from p on, if both have
    a token boundary at p and the same tokens from p to the next such place. p keeps ``edge``
    characters from either end of the overlap, where cut special strings and cut matches
    stand. Where no place qualifies, the overlap doubles, until the rest is one chunk.
    """
    out: list[int] = []
    begin, start = 0, 0  # the chunk's first character; from where its tokens count
    end = min(len(text), chunk)
    ids, spans = _encode(tokenizer, text[:end])
    while end < len(text):
        wide = overlap
        while True:
            nxt = max(begin, end - wide)
            if nxt <= start:  # the overlap has eaten the chunk: take more text at once
                end = min(len(text), end + max(chunk, end - begin))
                ids, spans = _encode(tokenizer, text[begin:end])
                if end == len(text):
                    break
                wide = overlap
                continue
            far = min(len(text), end + chunk)
            right_ids, right = _encode(tokenizer, text[nxt:far])
            places = [nxt + m.start() for m in _boundary.finditer(text[nxt:end])]
            places = [p for p in places if nxt + edge <= p <= end - edge and p > start]
            cut = next((c for p, q in zip(places, places[1:]) if (c := _common(ids, spans, begin, right_ids, right, nxt, p, q))), None)
            if cut:
                break
            wide *= 2
        if end == len(text):
            break
        p, left_to, right_from = cut
        skip = sum(1 for a, b in spans if begin + b <= start)
        out += ids[skip:left_to]
        begin, start, end, ids, spans = nxt, p, far, right_ids, right
    skip = sum(1 for a, b in spans if begin + b <= start)
    return out + ids[skip:]


def _common(ids, spans, begin, right_ids, right, nxt, p, q):
    """(p, tokens of the left chunk up to p, of the right one) if both agree from p to q."""
    a, b = _count(spans, p - begin), _count(right, p - nxt)
    c, d = _count(spans, q - begin), _count(right, q - nxt)
    if None in (a, b, c, d) or ids[a:c] != right_ids[b:d]:
        return None
    return p, a, b


def _count(spans, at):
    """Tokens that end by ``at``; None if one reaches across."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        if spans[mid][1] <= at:
            lo = mid + 1
        else:
            hi = mid
    return None if lo < len(spans) and spans[lo][0] < at else lo


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE) -> DataFrame:
    """Token count of every whole text by the tokenizer file, without begin or end tokens.

    Texts over ``huge`` characters go through ``splice_ids``; shorter ones are summed from
    their stable units, each distinct unit encoded once a worker (``common.Units``). Null text: empty, 0 tokens.
    Repeated rows stay, null ids stay. An empty table gives no rows, extra columns are not
    read. Map only.
    """

    def run(cols):
        tokenizer, kept = _tokenizer(path)
        kept.ready()
        texts = [t or "" for t in cols["text"]]
        cut = [stable_units(t) if len(t) <= huge else None for t in texts]
        new = list({u for us in cut if us for u in us if u not in kept})
        kept.update(zip(new, (len(x) for x in tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        n = [len(splice_ids(t, tokenizer, chunk, overlap)) if us is None else sum([kept[u] for u in us]) for t, us in zip(texts, cut)]
        kept.done(new, 200)
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
