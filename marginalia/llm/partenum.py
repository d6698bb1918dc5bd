"""Jaccard self-join on word shingles by PartEnum signatures, exact, with its components.

Sizes fall into bands; two sets that reach the threshold lie in one band or in neighbours, and
in the larger band's instance their Hamming distance is at most a k that the band fixes. Each
instance cuts the shingles' domain into parts. With one part more than k, some part is equal in
both sets; with half as many parts, each cut into three, some two of three are. A signature is
a set's content of such a subset of parts, so sets that reach the threshold share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, fresh
from .components import components

#: Bytes up to which a word's hash is a polynomial; of longer words it is a keyed digest.
LONG_WORD = 64
#: Below this k, parts are cut into three and subsets of two enumerated; above, parts alone.
ENUMERATE_BELOW = 16
#: Signature rows that a task holds at once, and bytes of text shingled at once.
ROWS_A_TASK, BLOCK = 3_000_000, 1_000_000
#: Bits of the filter that keeps texts nobody needs out of a shuffle: 1 MB.
FILTER_BITS = 2**23
#: Classes in a block of an open bucket, on average; a task compares two blocks at a time.
BUCKET_ROWS = 1000
#: Bytes of sketches that are compared at once.
SKETCH_BYTES = 2**24
_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        steps = np.full(max(n, BLOCK), base, np.uint64)
        steps[0] = 1
        kept = _powers[int(base)] = np.cumprod(steps)
    return kept[:n]


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of all its words if fewer."""
    out: list = []
    begin, size = 0, 0
    data = [(t or "").encode() for t in texts]
    for i, d in enumerate(data):
        size += len(d) + 1
        if size >= BLOCK or i == len(data) - 1:
            out += _shingle_block(data[begin : i + 1], n)
            begin, size = i + 1, 0
    return out


def _shingle_block(data: list[bytes], n: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * _power(_BASE, len(raw)))])
    words = mix((upto[ends] - upto[starts]) * _power(_BACK, len(raw))[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        words[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes().lower(), digest_size=8, key=b"word").digest(), "little")
    lens = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
    if len(words) >= n:
        m = len(words) - n + 1
        grams = words[:m].copy()
        for j in range(1, n):
            grams = mix(grams * _M2 + words[j : j + m])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            g = np.array([b - a], np.uint64)
            for w in words[a:b]:
                g = mix(g * _M2 + w)
            out.append(g)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order of its members."""
    return tuple(int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x1234567, 0x7654321))


def bands(most: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands [l, r]: sets of sizes l.. reach the threshold at most with sizes up to r."""
    out, lo = [], 1
    while lo <= most:
        hi = lo * den // num
        out.append((lo, hi))
        lo = hi + 1
    return out


class Signatures:
    """Signatures of sets for the threshold num/den."""

    def __init__(self, num: int, den: int, most: int = 2**33):
        self.num, self.den = num, den
        edges = bands(most, num, den)
        self.low = np.array([a for a, _ in edges])
        self.k = np.array([2 * b * (den - num) // (den + num) for _, b in edges])

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the set, signature) rows of many sets; each takes its band's instance
        and the next one's."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        band = np.searchsorted(self.low, sizes, "right") - 1
        found = []
        for step in (0, 1):
            k = self.k[band + step]
            for split in (True, False):
                at = np.flatnonzero((sizes > 0) & (k > 0) & ((k < ENUMERATE_BELOW) == split))
                if len(at):
                    found.append(self._instance([sets[i] for i in at], at, (band + step)[at], k[at], split))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _instance(self, sets, at, band, k, split):
        need = (k + 2) // 2 if split else k + 1
        # a few parts more than needed, so that nearly every set has enough parts with content
        parts = need + need // 25 + 1
        inner = 3 if split else 1
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        owner = np.repeat(np.arange(len(sets)), sizes)
        h = mix(np.concatenate(sets) ^ (band.astype(np.uint64) * _M1)[owner])
        base = np.concatenate([[0], np.cumsum(parts * inner)])
        cell = base[owner] + (((h >> np.uint64(32)) * (parts * inner).astype(np.uint64)[owner]) >> np.uint64(32)).astype(np.int64)
        body = mix(h)
        low = np.bincount(cell, (body & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
        high = np.bincount(cell, (body >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
        content = (low + (high << np.uint64(32))).reshape(-1, inner)
        count = np.bincount(cell, minlength=base[-1]).reshape(-1, inner)
        of = np.repeat(np.arange(len(sets)), parts)  # the set of each outer part
        place = np.arange(len(of)) - (base[:-1] // inner)[of]
        subsets = [(0, 1), (1, 2), (0, 2)] if split else [(0,)]
        filled = np.stack([sum(count[:, c] for c in s) > 0 for s in subsets], 1)
        whole = np.bincount(of, filled.all(1), len(sets))
        # A pair within k differs in k places at most, so among a set's outer parts whose subsets
        # all have content, enough of them leave one untouched: empty subsets aren't needed.
        enough = whole * (2 if split else 1) > k
        out_at, out_sig = [], []
        for j, s in enumerate(subsets):
            go = filled[:, j] | ~enough[of]
            x = np.full(go.sum(), j + 1, np.uint64)
            for c in s:
                x = mix(x * _M2 + content[go, c])
            x = mix(x ^ (place[go].astype(np.uint64) * _M1 + band[of[go]].astype(np.uint64) * _M2))
            out_at.append(at[of[go]])
            out_sig.append(x)
        return np.concatenate(out_at), np.concatenate(out_sig)


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit a cell: whether the set has an odd number of members there. Two sets' sketches
    differ in no more bits than the sets differ in members, also after halving by XOR."""
    cells = 1 << max(6, int(2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((mix(s ^ _M1) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) at a smaller power-of-two width."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def likely_pairs(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sketches: list[bytes], num: int, den: int, sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket, from different components (and sides, if given), that size and sketch
    don't rule out. Blocks of rows against all; what they rule out is below the threshold for certain."""
    order = np.argsort(sizes, kind="stable")
    ids, comps, sizes = ids[order], comps[order], sizes[order]
    sides = None if sides is None else sides[order]
    data = [sketches[i] for i in order]
    for s in range(0, len(ids), 256):
        e = min(len(ids), s + 256)
        upto = np.searchsorted(sizes, sizes[e - 1] * den // num, "right")
        width = min(map(len, data[s:e]))
        left = np.concatenate([fold(np.frombuffer(d, np.uint8)[None], width) for d in data[s:e]])
        for t in range(s, upto, 1024):
            u = min(upto, t + 1024)
            right = np.concatenate([fold(np.frombuffer(d, np.uint8)[None], width) for d in data[t:u]])
            both = sizes[s:e, None] + sizes[None, t:u]
            ok = (np.arange(s, e)[:, None] < np.arange(t, u)) & (comps[s:e, None] != comps[None, t:u])
            if sides is not None:
                ok &= sides[s:e, None] != sides[None, t:u]
            ok &= np.minimum(sizes[s:e, None], sizes[None, t:u]) * den >= np.maximum(sizes[s:e, None], sizes[None, t:u]) * num
            i, j = np.nonzero(ok)
            step = max(1, min(100_000, SKETCH_BYTES // width))
            for c in range(0, len(i), step):
                a, b = i[c : c + step], j[c : c + step]
                far = np.bitwise_count(left[a] ^ right[b]).sum(1, dtype=np.int64)
                near = far * (den + num) <= both[a, b] * (den - num)
                yield from ((min(x, y), max(x, y)) for x, y in zip(ids[s + a[near]].tolist(), ids[t + b[near]].tolist()))


def _batches(cols: list[np.ndarray], schema: pa.Schema, step: int = 100_000):
    for s in range(0, len(cols[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + step], f.type) for c, f in zip(cols, schema)], schema=schema)


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                sets = shingle_sets(batch.column(1).slice(s, 1000).to_pylist(), n)
                f = [fingerprint(x) for x in sets]
                cols = [batch.column(0).slice(s, 1000), *(pa.array(v, pa.int64()) for v in ([len(x) for x in sets], [x[0] for x in f], [x[1] for x in f]))]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    found = cut(docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long"), "partenum-sets")
    # written first, so that the join back has an exchange of its own, which Spark splits where a
    # set has very many copies
    firsts = found.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    firsts = cut(firsts.where("copies > 1").drop("copies"), "partenum-copied")
    joined = found.join(firsts, ["n", "f1", "f2"], "left")
    return cut(joined.select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "partenum-nodes")


def _tasks(df: DataFrame, rows: int) -> int:
    """Partitions that hold ``ROWS_A_TASK`` rows at most, the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def _shared_signatures(docs: DataFrame, n: int, num: int, den: int, rows: int) -> DataFrame:
    """(sig, head, members, doc_id) of the signatures that several documents have: the head is
    the smallest of them, members their number, 3 if there are more. A task emits equal sets once, so copies arrive once a task at most."""
    schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64())])
    out = pa.schema([("sig", pa.int64()), ("head", pa.int64()), ("members", pa.int64()), ("doc_id", pa.int64())])

    def emit(batches):
        make, seen = Signatures(num, den), set()
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                ids = batch.column(0).slice(s, 500).to_numpy(zero_copy_only=False)
                new, sets = [], shingle_sets(batch.column(1).slice(s, 500).to_pylist(), n)
                for i, x in enumerate(sets):
                    if len(x) and (f := fingerprint(x)) not in seen:
                        seen.add(f)
                        new.append(i)
                at, sig = make.of([sets[i] for i in new])
                order = np.argsort(at, kind="stable")  # a document's rows together shuffle smaller
                yield from _batches([sig[order].view(np.int64), ids[new][at[order]].astype(np.int64) if len(new) else sig.view(np.int64)], schema)

    def bucket_rows(sig, head, members, doc):
        many = members > 1
        yield from _batches([sig[many], head[many], members[many], doc[many]], out)

    def buckets(batches):
        # Rows come in order. Between batches only a signature's first two rows are held; once
        # it has three its head is known and its rows go on as they come.
        sig, doc, last, big = np.empty(0, np.int64), np.empty(0, np.int64), None, None
        for batch in batches:
            s, d = (batch.column(i).to_numpy() for i in range(2))
            if not len(s):
                continue
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            fresh[0] = (s[0], d[0]) != last
            last = s[-1], d[-1]
            s, d = s[fresh], d[fresh]
            if big is not None:
                k = int(np.searchsorted(s, big[0], "right"))
                yield from bucket_rows(s[:k], np.full(k, big[1]), np.full(k, 3), d[:k])
                s, d = s[k:], d[k:]
            if not len(s):
                continue
            sig, doc, big = np.concatenate([sig, s]), np.concatenate([doc, d]), None
            begins = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            lens = np.diff(np.concatenate([begins, [len(sig)]]))
            e = begins[-1] if lens[-1] < 3 else len(sig)
            if lens[-1] > 2:
                big = sig[-1], doc[begins[-1]]
            yield from bucket_rows(sig[:e], np.repeat(doc[begins], lens)[:e], np.repeat(np.minimum(lens, 3), lens)[:e], doc[:e])
            sig, doc = sig[e:], doc[e:]
        yield from bucket_rows(sig, np.full(len(sig), doc[0] if len(doc) else 0), np.full(len(sig), len(sig)), doc)

    found = docs.where(F.col("doc_id").isNotNull()).mapInArrow(emit, "sig long, doc_id long")
    tasks = _tasks(docs, rows)
    found = found.repartition(tasks, "sig").sortWithinPartitions("sig", "doc_id")
    return cut(found.mapInArrow(buckets, "sig long, head long, members long, doc_id long"), "partenum-buckets")


def _pack_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Compressed texts of the documents whose ids are in ``needed``.

    A bitmap of ``FILTER_BITS`` hashed ids, of one size whatever the corpus, goes with the scan
    and keeps most other texts out of the shuffle; the semi-join decides.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = needed.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    size = 4096 * 8
    bits = bytearray(FILTER_BITS // 8 + size // 8)
    for r in maps:
        at = (r["k"] - 1) * (size // 8)
        bits[at : at + size // 8] = r["bits"]
    bits = bytes(bits)
    # bucket numbers start at 1 and hold 32768 places each
    schema = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches):
        press, have = zstandard.ZstdCompressor(9), np.frombuffer(bits, np.uint8)
        for batch in batches:
            k, pos = (batch.column(i).to_numpy() for i in (2, 3))
            byte = (k - 1) * (size // 8) + pos // 8
            keep = pa.array((have[byte] >> (pos % 8).astype(np.uint8)) & 1 == 1)
            ids, texts = batch.column(0).filter(keep), batch.column(1).filter(keep)
            z = [press.compress((t or "").encode()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(z, pa.binary())], schema=schema)

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("pos"))
    return rows.mapInArrow(run, "doc_id long, z binary").join(needed, "doc_id", "left_semi")


def _unpack(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode()


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    schema = pa.schema([("class_id", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            made = [parity_sketch(x) for x in shingle_sets([_unpack(z) for z in batch.column(1).to_pylist()], n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=schema)

    return texts.mapInArrow(run, "class_id long, sketch binary")


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ at the width of the shorter one."""
    if len(a) < len(b):
        a, b = b, a
    x, width = int.from_bytes(a, "little"), len(a)
    while width > len(b):
        width //= 2
        x = (x & ((1 << 8 * width) - 1)) ^ (x >> 8 * width)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _unruled(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b, both sizes' sum) those that their sketches don't rule out for
    certain: the sketches of others differ in more bits than sets within the threshold may."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, both, x, y = (c.to_pylist() for c in batch.columns)
            keep = pa.array([differing(s, t) * (den + num) <= m * (den - num) for m, s, t in zip(both, x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    x, y = (sketches.select(F.col("class_id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "both", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of documents that reach the threshold by their shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, za, zb = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                sets = []
                for key, z in ((a[i].as_py(), za[i]), (b[i].as_py(), zb[i])):
                    if key not in kept:
                        if len(kept) > 500:
                            kept.clear()
                        kept[key] = shingle_sets([_unpack(z.as_py())], n)[0]
                    sets.append(kept[key])
                x, y = sets
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * same >= num * (len(x) + len(y) - same) and same > 0)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], schema=schema)

    za, zb = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))
    return pairs.join(za, "a").join(zb, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Of the rows (sig, class_id, n, component), once each, those of buckets with three classes
    or more that don't form one component, dealt into tiles (sig, x, y) of two blocks.

    A bucket of ``BUCKET_ROWS`` classes at most is one tile. Of a larger one, the classes of its
    largest component and the others are cut into blocks by a hash; each block of others meets
    every block, blocks of the largest component don't meet each other. So all pairs from
    different components share a tile; a class's side there is its block.
    """
    rows = cut(members.select("sig", "class_id", "n", "component"), "partenum-members")
    mixed = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    rows = cut(rows.join(mixed, "sig", "left_semi").distinct(), "partenum-open")
    each = rows.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = each.groupBy("sig").agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("most")).where("size > 2")
    blocks = [F.ceil(c / BUCKET_ROWS).cast("int").alias(name) for c, name in ((F.col("most.k"), "mains"), (F.col("size") - F.col("most.k"), "others"))]
    sizes = sizes.select("sig", (F.col("size") <= BUCKET_ROWS).alias("small"), F.col("most.component").alias("main"), *blocks)
    is_main, h = F.col("component") == F.col("main"), F.xxhash64("class_id")
    # blocks of the largest component have numbers below 0
    side = F.when(F.col("small"), 0).when(is_main, -1 - F.pmod(h, "mains")).otherwise(F.pmod(h, "others")).cast("int")
    other = F.when(F.col("small"), F.array(F.lit(0))).when(is_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("others") - 1))
    dealt = rows.join(sizes, "sig").select("sig", "class_id", "n", "component", side.alias("side"), F.explode(other).alias("other"))
    return dealt.select("sig", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "class_id", "n", "component", "side")


def _residual_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Likely pairs (a, b) inside the tiles of buckets that still hold several components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        tile, rows = None, []

        def done():
            if len(rows) > 1:
                ids, comps, sizes, sketches, sides = zip(*rows)
                sides = None if tile[1] == tile[2] else np.array(sides)
                pairs = iter(likely_pairs(np.array(ids), np.array(comps), np.array(sizes), list(sketches), num, den, sides))
                while some := list(islice(pairs, 100_000)):
                    yield from _batches([np.array(x) for x in zip(*some)], schema)

        for batch in batches:
            for s, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (s, x, y) != tile:
                    yield from done()
                    tile, rows = (s, x, y), []
                rows.append(row)
        yield from done()

    dealt = members.select("sig", "x", "y", "class_id", "component", "n", "sketch", "side").repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the smallest id that
    links reach. Documents link where the Jaccard similarity of their n-word shingle sets is
    num/den or more.

    Equal sets are one class. Each shared signature links its members' classes to its smallest
    one if sizes and parity sketches allow it and their texts confirm it; where a bucket still holds several components, its other
    pairs follow, but for those that size or parity sketch rule out for certain. So every link
    between different texts is found, or both ends are known to be connected. Null or blank
    texts have empty sets and link with nothing. Rows of one id are one document. A row with a
    null id takes the component of its class, null if none has an id. Ids are whole numbers, as
    components are named by the smallest: other types raise a TypeError. Extra columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} holds {docs.schema[id_col].dataType.simpleString()}, not whole numbers")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nodes = _nodes(docs, n)
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = _shared_signatures(docs, n, num, den, shingles * 6 // 10)
    of = nodes.where("doc_id is not null and n > 0").select("doc_id", "class_id", "n").distinct()

    def as_(end: str):
        return of.select(F.col("doc_id").alias(end), F.col("class_id").alias(f"{end}_class"), F.col("n").alias(f"{end}_n"))

    stars = buckets.where("head <> doc_id").select("head", F.col("doc_id").alias("other")).distinct()
    stars = stars.join(as_("head"), "head").join(as_("other"), "other").where("head_class <> other_class")
    fits = (F.least("head_n", "other_n") * den) >= (F.greatest("head_n", "other_n") * num)
    both = (F.col("head_n") + F.col("other_n")).alias("both")
    stars = cut(stars.select(F.least("head_class", "other_class").alias("a"), F.greatest("head_class", "other_class").alias("b"), both, fits.alias("fits")).distinct(), "partenum-stars")
    needed = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    texts = cut(_pack_texts(docs, needed), "partenum-texts")
    sketches = cut(_sketches(texts, n), "partenum-sketches")
    tested = cut(_unruled(stars.where("fits"), sketches, num, den), "partenum-tested")
    links = cut(_verified(tested, texts, n, num, den), "partenum-links")
    first = components(links)

    # a bucket of two has no pair but the tested one
    known = of.join(first.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", "class_id", "n", F.coalesce("component", "class_id").alias("component"))
    members = _open_buckets(buckets.where("members > 2").select("sig", "doc_id").join(known, "doc_id"))
    rest = _residual_pairs(members.join(sketches, "class_id"), num, den)
    rest = rest.join(tested, ["a", "b"], "left_anti")
    more = cut(_verified(rest, texts, n, num, den), "partenum-more")
    groups = components(links.union(more)) if more.limit(1).count() else first
    out = nodes.join(groups.withColumnRenamed("id", "class_id"), "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a smaller id of their group stands for, and without
    repeated rows of one id, with their own columns. Rows with a null id stay, as do null and
    blank texts. Ids as for ``jaccard_groups``."""
    groups = jaccard_groups(docs, n, num, den, id_col, text_col)
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = F.col(id_col).isNotNull()
        docs = docs.where(known).dropDuplicates([id_col]).union(docs.where(~known))
    gone = fresh(docs, "gone")
    smaller = groups.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(smaller, F.col(id_col).cast("long") == F.col(gone), "left_anti")
