"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIGEST = 16  # bytes of a turn's digest
FAN = 64  # neighbouring forests that are merged at once
PIECE = 1_000_000  # characters of a piece of a list of ids
SHARED = 20  # conversations that may share one head
OPEN, NONE = 1 << 60, -1  # depth of an edge that is not known yet; of no edge
_WORD = r"[^\x20\x09-\x0D]+"
_ITEM = "n long, least long, w long, leaves long, q long, kids long, ends long"
_FOUND = f"kind string, {_ITEM}, p long, edge long, edge_w long, part long, idx long, head binary, head_upto array<long>, tail binary, tail_upto array<long>, name string, text string"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, upto): a conversation's turn digests, concatenated in order, and the words up
    to each turn, of every conversation rebuilt on the head of the first of its twenty."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    c = F.col("conv_id").cast("long")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        c.alias("conv_id"), (c - c % SHARED).alias("first"),
        F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("turn"),
    )
    own = rows.repartition("first").groupBy("first", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    most = F.max(F.when(F.col("conv_id") == F.col("first"), F.slice("turns", 1, 3))).over(Window.partitionBy("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    whole = own.withColumn("head", most).withColumn("h", h).select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))
    key = F.expr("coalesce(unhex(array_join(transform(turns, t -> hex(t.digest)), '')), cast('' AS binary))")
    return whole.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")).mapInArrow(_summed, "conv_id long, key binary, upto array<long>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums inside each list of words, a batch at a time."""
    for batch in batches:
        words = batch.column("words")
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        offsets = words.offsets.to_numpy().astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(words.values.to_numpy(zero_copy_only=False)[: offsets[-1]])])
        upto = sums[offsets[0] + 1 : offsets[-1] + 1] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(upto.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("key"), lists], names=["conv_id", "key", "upto"])


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common from the start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    d = 0
    while a[d : d + DIGEST] == b[d : d + DIGEST]:
        d += DIGEST
    return d // DIGEST


class Forest:
    """Components of neighbouring items, merged along edges in descending depth.

    An item is (n, least, w, leaves, q, kids, ends): conversations, smallest id, words that the
    merged neighbours have in common, leaves below closed children, depth of its node, children of
    that node, smallest id that ends there. Edge i, (depth, words), joins items i and i + 1.
    """

    def __init__(self, items: list[tuple], edges: list[tuple[int, int]], closed: bool):
        self.items, self.edges, self.nodes = [list(x) for x in items], edges, []
        self.top, self.outer = list(range(len(items))), NONE if closed else OPEN
        self.first, self.last = list(range(len(items))), list(range(len(items)))

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = i = self.top[self.top[i]]
        return i

    def beside(self, edge: int) -> int:
        return self.edges[edge][0] if 0 <= edge < len(self.edges) else self.outer

    def close(self, i: int, p: int) -> None:
        """Item ``i`` is whole: a node of depth q below one of depth p, whose child it becomes."""
        n, least, w, leaves, q, kids, ends = self.items[i]
        leaves = leaves if kids else 1
        self.nodes.append((n, least, w, leaves, q, kids, ends, p))
        self.items[i] = [n, least, w, leaves, p, 1, None]

    def merge(self) -> tuple[list[tuple], list[tuple], list[tuple[int, int]]]:
        """Nodes that are whole, the items that are left and the edges between them.

        An edge waits if an item beside it may still grow at a greater depth: it touches an end
        of this forest that has neighbours elsewhere, or an edge that waits itself. So what is
        left has at most two items for each depth.
        """
        waits = []
        for e in sorted(range(len(self.edges)), key=lambda e: -self.edges[e][0]):
            d, words = self.edges[e]
            a, b = self.find(e), self.find(e + 1)
            if not all(self.items[x][4] == d or self.beside(at) <= d for x, at in ((a, self.first[a] - 1), (b, self.last[b]))):
                waits.append(e)
                continue
            for x in (a, b):
                if self.items[x][4] > d:
                    self.close(x, d)
            x, y = self.items[a], self.items[b]
            ends = min((v for v in (x[6], y[6]) if v is not None), default=None)
            self.items[a] = [x[0] + y[0], min(x[1], y[1]), x[2] + y[2] + words, x[3] + y[3], d, x[5] + y[5], ends]
            self.top[b], self.last[a] = a, self.last[b]
        left = [i for i in range(len(self.items)) if self.top[i] == i]
        if self.outer == NONE and left:
            self.close(left[0], -1)
        return self.nodes, [tuple(self.items[i]) for i in left], [self.edges[e] for e in sorted(waits)]


def _rows(kind: str, items: list[tuple], **more) -> dict[str, list]:
    names = [x.split()[0] for x in _ITEM.split(", ")]
    return {"kind": [kind] * len(items), **{k: list(v) for k, v in zip(names, zip(*[x[:7] for x in items]))}, **more} if items else {}


def _spine(items, edges, part, head, tail) -> dict[str, list]:
    """What is left of a forest, with the sequences at its two ends."""
    if not items:
        return {}
    more = len(items) - 1
    at = [*edges, (None, None)]
    return _rows(
        "spine", items, edge=[x[0] for x in at], edge_w=[x[1] for x in at], part=[part] * len(items), idx=list(range(len(items))),
        head=[head[0], *[None] * more], head_upto=[head[1], *[None] * more], tail=[*[None] * more, tail[0]], tail_upto=[*[None] * more, tail[1]],
    )


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], _FOUND).schema)


def _batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values()), []))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(x.name, [None] * n), x.type) for x in schema], schema=schema)


def local_forests(rows: DataFrame) -> DataFrame:
    """Of each partition of sorted sequences: nodes that are whole, the rest as a spine, digests of
    the ids that end at one sequence, and these ids as text where the sequence may go on in a
    neighbouring partition. A task keeps three numbers a conversation."""
    schema = _arrow(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items, edges = TaskContext.get().partitionId(), [], []
        head = last = None
        same: list[int] = []
        ends: dict[str, list] = {k: [] for k in ("kind", "ends", "name", "text", "part", "idx")}

        def flush(final: bool) -> None:
            """The ids of the sequence just read, as a digest or, at an end of the partition, as pieces."""
            text, inner = ",".join(map(str, same)), last[0] != head[0] and not final
            name, seq = hashlib.sha256(last[0]).hexdigest(), 0
            if inner:
                pieces = [hashlib.sha256(text.encode()).hexdigest()]
            else:
                pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
            for seq, piece in enumerate(pieces):
                for k, v in (("kind", "ends" if inner else "piece"), ("ends", same[0]), ("name", name), ("text", piece), ("part", part), ("idx", seq)):
                    ends[k].append(v)

        for batch in batches:
            for conv, key, upto in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "key", "upto")]):
                if last is None:
                    head = (key, upto)
                else:
                    d = common(last[0], key)
                    edges.append((d, upto[d - 1] if d else 0))
                    if key != last[0]:
                        flush(False)
                        same = []
                items.append((1, conv, 0, 0, len(key) // DIGEST, 0, conv))
                same.append(conv)
                last = (key, upto)
            if len(ends["kind"]) > 1000:
                yield _batch(schema, ends)
                ends = {k: [] for k in ends}
        if last is None:
            return
        flush(True)
        yield _batch(schema, ends)
        nodes, left, between = Forest(items, edges, False).merge()
        for i in range(0, len(nodes), 10_000):
            some = nodes[i : i + 10_000]
            yield _batch(schema, _rows("node", some, p=[x[7] for x in some]))
        yield _batch(schema, _spine(left, between, part, head, last))

    return rows.mapInArrow(scan, _FOUND)


def merged_forests(spines: DataFrame, closed: bool) -> DataFrame:
    """Neighbouring spines, ``FAN`` at a time, joined by the common prefix at each boundary and
    merged again; ``closed`` where one group holds all."""
    schema = _arrow(spines)

    def run(found: pa.Table) -> pa.Table:
        rows = found.sort_by([("part", "ascending"), ("idx", "ascending")]).to_pylist()
        names, items, edges, last = [x.split()[0] for x in _ITEM.split(", ")], [], [], None
        for r in rows:
            if r["idx"] == 0 and last:
                d = common(last["tail"], r["head"])
                edges.append((d, r["head_upto"][d - 1] if d else 0))
            items.append(tuple(r[k] for k in names))
            if r["edge"] is not None:
                edges.append((r["edge"], r["edge_w"]))
            last = r
        nodes, left, between = Forest(items, edges, closed).merge()
        batches = [_batch(schema, _rows("node", nodes, p=[x[7] for x in nodes]))]
        if not closed:
            batches.append(_batch(schema, _spine(left, between, rows[0]["part"] // FAN, (rows[0]["head"], rows[0]["head_upto"]), (last["tail"], last["tail_upto"]))))
        return pa.Table.from_batches(batches, schema)

    return spines.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, _FOUND)


def _joined(pieces: DataFrame) -> DataFrame:
    """Digests of the id lists that lie in pieces. SHA-256 takes a list in order, so the pieces of
    one list pass one task, a piece at a time; there are two lists a partition at most."""
    ordered = pieces.select("name", "part", "idx", "ends", "text").repartition("name").sortWithinPartitions("name", "part", "idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = first = digest = part = None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.name != name:
                    if digest:
                        out.append((first, digest.hexdigest()))
                    name, first, digest = r.name, r.ends, hashlib.sha256()
                elif r.part != part:
                    digest.update(b",")
                part = r.part
                digest.update(r.text.encode())
            if out:
                yield pd.DataFrame(out, columns=["ends", "text"])
        if digest:
            yield pd.DataFrame([(first, digest.hexdigest())], columns=["ends", "text"])

    return ordered.mapInPandas(run, "ends long, text string")


def trie(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``
    of every node of the prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Sequences of turn digests are range partitioned over (sequence, id), so that copies split
    evenly. Neighbours in a sorted partition share a prefix; union-find merges them in descending
    depth of it, and every merge makes a branching node. What may go on beyond a partition is
    contracted to its spine, and spines are merged by 64 neighbours at a time up to one forest.
    Nodes between a branching node and its parent differ in depth alone and come last.

    Turns of one rank, and repeated rows, are ordered by their digests. Rows of a null conv_id
    belong to no conversation. Null roles and texts are empty. An empty table gives no rows.
    Further columns have no part. One conversation is one row of 24 bytes a turn, which bounds the
    turns of a single conversation to some tens of millions; their texts are never held.
    """
    spark = turns.sparkSession
    convs = cut(sequences(turns), "sequences")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = convs.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = [cut(local_forests(ordered), "forests")]
    last = found[0].where("kind = 'spine'").agg(F.max("part")).first()[0] or 0
    while True:
        found.append(cut(merged_forests(found[-1].where("kind = 'spine'"), last < FAN), "forests"))
        if last < FAN:
            break
        last //= FAN
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.union(more)
    nodes = nodes.where("kind = 'node'").select("n", "least", "w", "leaves", "q", "kids", "ends", "p")
    prefix = lambda depth: F.expr(f"sha2(substring(key, 1, {DIGEST} * {depth}), 256)")
    nodes = cut(nodes.join(convs.withColumnRenamed("conv_id", "least"), "least").select("*", prefix("q").alias("own"), prefix("greatest(p, 0)").alias("up")).drop("key"), "nodes")
    above = nodes.select(F.col("least").alias("above"), F.col("q").alias("p"), F.col("own").alias("up"))
    ends = found[0].where("kind = 'ends'").select("ends", "text").union(_joined(found[0].where("kind = 'piece'")))
    full = nodes.join(above, ["p", "up"], "left").join(ends, "ends", "left").withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("q"))))
    before = F.when(F.col("depth") > 1, F.expr("try_element_at(upto, greatest(cast(depth AS int) - 1, 1))")).otherwise(0)
    own = F.col("depth") == F.col("q")
    return full.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("p") + 1, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(own, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("w") - (F.col("n") - 1) * before).alias("saved_tokens"), F.coalesce(F.when(own, F.col("text")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: DuckDB SQL of the op11 query: nodes as groups of equal prefixes, subtrees by the ancestors of each node.
_CRC = "xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"
SQL = rf"""
WITH o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (SELECT c.conv_id, 0 AS side, k, x, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE k <= h UNION ALL SELECT conv_id, 1, k, x, words FROM c JOIN o USING (conv_id) WHERE k > h),
d AS (SELECT conv_id, row_number() OVER w AS d, string_agg(x, '') OVER w AS path, words FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY side, k)),
r AS MATERIALIZED (SELECT conv_id, d, sha256(path) AS path, words FROM d UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
v AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM r GROUP BY path, d),
u AS (SELECT a.path, a.d, a.conv_id, a.n, a.words, b.path AS up FROM v a LEFT JOIN r b ON b.conv_id = a.conv_id AND b.d = a.d - 1),
kids AS MATERIALIZED (SELECT up AS path, count(*) AS k FROM u WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT r.path, count(*) FILTER (coalesce(k, 0) = 0) AS leaves, sum((v.n - 1) * v.words) AS saved FROM v LEFT JOIN kids ON kids.path = v.path JOIN r ON r.conv_id = v.conv_id AND r.d <= v.d GROUP BY r.path),
z AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, d) AS path FROM r GROUP BY conv_id) GROUP BY path)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, u.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM u LEFT JOIN v o ON o.path = u.up LEFT JOIN kids ON kids.path = u.path LEFT JOIN z ON z.path = u.path JOIN s ON s.path = u.path"""
