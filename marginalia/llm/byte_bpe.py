"""Byte-level BPE encoding and decoding in padded numpy matrices."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import RankEncoder, stable_units
from .common import Units, map_rows

_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    if path not in _loaded:
        _loaded[path] = RankEncoder(path), regex.compile(public_tokenizers.PATTERN), Units(96_000_000)
    return _loaded[path]


def encode_units(units: Iterable[str], path: str) -> dict[str, list[int]]:
    """Ids of each unit: every pattern match is encoded by itself, equal matches once."""
    encoder, pattern, _ = _encoder(path)
    pieces = {u: pattern.findall(u) for u in units}
    words = list({p for ps in pieces.values() for p in ps})
    ids = dict(zip(words, encoder.encode_words([w.encode() for w in words])))
    return {u: [i for p in ps for i in ids[p]] for u, ps in pieces.items()}


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of whole texts, as the rank file's library gives them without special tokens."""
    cut = [stable_units(t or "") for t in texts]
    ids = encode_units({u for us in cut for u in us}, path)
    return [[i for u in us for i in ids[u]] for us in cut]


def decode_ids(ids: list[int], path: str) -> bytes:
    """Bytes of a list of ids."""
    return b"".join(map(_encoder(path)[0].bytes_of.__getitem__, ids))


def byte_bpe(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again: token count and digests a row.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows stay repeated,
    null ids stay null. Map only; memory is one Arrow batch and ``common.Units``.
    """

    def run(cols):
        kept = _encoder(path)[2]
        kept.ready()
        n, coded, decoded = [], [], []
        cut = [stable_units(t or "") for t in cols["text"]]
        new = list({u for us in cut for u in us if u not in kept})
        for u, ids in encode_units(new, path).items():
            kept[u] = len(ids), " ".join(map(str, ids)), decode_ids(ids, path)
        for us in cut:
            got = [kept[u] for u in us]
            n.append(sum(x[0] for x in got))
            coded.append(sha256(" ".join([x[1] for x in got]).encode()).hexdigest())
            decoded.append(sha256(b"".join([x[2] for x in got])).hexdigest())
        kept.done(new, 350, sum(len(kept[u][1]) for u in new))
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": coded, "decoded_sha256": decoded}

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
