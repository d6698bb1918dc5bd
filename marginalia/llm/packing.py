"""Packing by concatenate and cut: two-pass prefix sums, then fixed windows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bpe import WordEndEncoder
from .common import Units, cut, map_rows, slices

#: Partitions up to which their offsets (some 16 bytes each) go to every task.
SMALL = 1_000_000
#: Bytes of words and their ids that a worker keeps: those of some batches, not only of one, which has up to 30 million.
KEPT = 96_000_000
_loaded: dict[str, tuple] = {}
#: Letters of one code point in composed form with a lower case of one code point, then other
#: ASCII characters but for the apostrophe and those of special strings: two pieces at most.
_plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=?@\\[-`{}~]*)")


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path), WordEndEncoder(path), Units(KEPT)
    return _loaded[path]


def _learn(words: list[str], path: str) -> None:
    """Keep the ids of words: plain ones by padded matrices, all others by the library."""
    tokenizer, own, kept = _tokenizer(path)
    pieces, count, plain, odd = [], [], [], []
    for w in words:
        if w and (m := _plain.fullmatch(w)):
            plain.append(w)
            a, b = m.groups()
            count.append(bool(a) + bool(b))
            if a:
                pieces.append(a.lower().encode())
            if b:
                pieces.append(b.encode())
        else:
            odd.append(w)
    if plain:
        flat, lens = own.encode_words(pieces)
        upto = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(count)] * 4
        data, ends = flat.astype("<u4").tobytes(), upto.tolist()
        kept.update(zip(plain, map(data.__getitem__, map(slice, [0, *ends], ends))))
    for s in range(0, len(odd), 20_000):
        for w, e in zip(odd[s : s + 20_000], tokenizer.encode_batch_fast(odd[s : s + 20_000], add_special_tokens=False)):
            kept[w] = np.array(e.ids, "<u4").tobytes()


def _ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of whole texts as little-endian 32-bit; this tokenizer drops white space and no
    match or special string holds any, so the words between blanks are encoded apart, equal
    words once a worker."""
    kept = _tokenizer(path)[2]
    kept.ready()
    cut = [t.replace("\n", " ").split(" ") for t in texts]
    words = list(chain.from_iterable(cut))
    new = list(set(words) - kept.keys())
    _learn(new, path)
    each = map(kept.__getitem__, words)
    yield from (b"".join(islice(each, len(ws))) for ws in cut)
    kept.done(new, 200)


def packed(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of ``size`` tokens; one row a piece.

    Pass 1 tokenizes each partition and stores ids (16 bits each where the vocabulary allows it)
    with running starts inside the partition; the partitions' totals, summed up in partition
    order, are global offsets. Pass 2 reads the ids where they lie, adds the offset and cuts each document at the multiples of ``size``. Only the last sequence is not
    full. Pieces that go on from or into another sequence say so (``continued``,
    ``continues``). Null text: empty, that is its end id alone. Repeated rows are packed each,
    null ids too. An empty table gives no rows, extra columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pass1 = pa.schema([("doc_id", _arrow(kind)), ("part", pa.int32()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    tail = np.array([end_id], "<u4").tobytes()
    width = "<u2" if max(end_id, *_tokenizer(path)[0].get_vocab(True).values()) < 2**16 else "<u4"

    def tokenize(batches):
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch):
                texts = [t or "" for t in some.column(1).to_pylist()]
                ids, starts, n = [], [], []
                for x in _ids(texts, path):
                    ids.append(np.frombuffer(x + tail, "<u4").astype(width).tobytes())
                    starts.append(at)
                    n.append(len(x) // 4 + 1)
                    at += n[-1]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(v, pass1.field(i + 1).type) for i, v in enumerate(([part] * len(n), starts, n, ids)))], schema=pass1)

    stored = cut(rows.mapInArrow(tokenize, f"doc_id {kind}, part int, local_start long, n long, ids binary"), "packing-ids")
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def windows(cols):
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued", "continues")}
        for doc, first, n, ids in zip(*(cols[k] for k in ("doc_id", "first", "n", "ids"))):
            ids = np.frombuffer(ids, width).astype("<u4")
            s = 0
            while s < n:
                e = min(n, s + size - (first + s) % size)
                for k, v in zip(out, (doc, s, e - s, zlib.crc32(ids[s:e].tobytes()), n, (first + s) // size, (first + s) % size, s > 0, e < n)):
                    out[k].append(v)
                s = e
        return out

    offsets = cut(offsets, "packing-offsets")
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)
    placed = stored.join(offsets, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("first"), "n", "ids")
    return map_rows(placed, windows, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continued boolean, continues boolean")


def _arrow(kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
