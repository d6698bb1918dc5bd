"""Merkle manifest of a table: levels of the hash tree as concatenated hex strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RUN = 3  # nodes under one parent
LEVELS = 5  # levels that a block holds above its own nodes
BLOCK = RUN**LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, the number from 0 of a row in its group by ``order`` (null first),
    and ``total``, the rows of its group.

    Range partitions over group and order hold any group in parts of like size; a count for each
    partition and group, summed up by a window of one row for each, gives the offsets.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = cut(dealt, "places").withColumn("part", F.shiftright("at", 33))
    sizes = dealt.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "part", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    placed = dealt.join(sizes, [*group, "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first"))
    return placed.drop("at", "part", "first", "before")


def _parents(level: Column) -> Column:
    """The next level's string: a digest of each run of ``RUN`` digests, the last run maybe shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (RUN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (RUN * HEX) + 1, F.lit(RUN * HEX)), 256)), "")


def blocks(nodes: DataFrame, group: list[str], keep: list[str]) -> DataFrame:
    """One row for each aligned block of ``BLOCK`` nodes (place, total, h): its rows in order, the
    levels ``l0`` to ``l5`` as strings as far as its group's tree has them, and its ``root``."""
    row = F.struct("place", "h", *keep)
    b = nodes.groupBy(*group, F.floor(F.col("place") / BLOCK).alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(row)).alias("rows"))
    b = b.withColumn("l0", F.array_join(F.transform("rows", lambda x: x["h"]), ""))
    for j in range(LEVELS):
        b = b.withColumn(f"l{j + 1}", F.when(F.col("total") > RUN**j, _parents(F.col(f"l{j}"))))
    return b.withColumn("root", F.coalesce(*[F.col(f"l{j}") for j in range(LEVELS, -1, -1)]))


def tiers(nodes: DataFrame, group: list[str], keep: list[str]) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks' roots, and so on to one block a group."""
    out = []
    while True:
        out.append(cut(blocks(nodes, group, keep if not out else []), "blocks"))
        if not out[-1].agg(F.max("block")).first()[0]:
            return out
        total = F.ceil(F.col("total") / BLOCK)
        nodes = out[-1].select(*group, F.col("block").alias("place"), total.alias("total"), F.col("root").alias("h"))


def _siblings(place: Column) -> Column:
    """What flanks a node's ancestors in their runs, level by level within its block."""
    steps = []
    for j in range(LEVELS):
        i = F.floor((place % BLOCK) / RUN**j).cast("int")
        a = i % RUN
        left = F.substring(f"l{j}", (i - a) * HEX + 1, a * HEX)
        right = F.substring(f"l{j}", (i + 1) * HEX + 1, (RUN - 1 - a) * HEX)
        steps.append(F.when(F.col("total") > RUN**j, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def descended(levels: list[DataFrame], group: list[str], above: DataFrame, keep: list[str]) -> DataFrame:
    """Nodes of the lowest tier with their ``path``: siblings from the node to the root of all.
    ``above`` has for each group its ``path`` from the group's root, and ``more`` columns."""
    more = [c for c in above.columns if c not in (*group, "block", "path")]
    for k, b in reversed(list(enumerate(levels))):
        taken = keep if k == 0 else []

        def node(x: Column) -> Column:
            return F.struct(x["place"].alias("place"), x["h"].alias("h"), F.concat(_siblings(x["place"]), F.col("path")).alias("path"), *[x[c].alias(c) for c in taken])

        made = b.drop("root").join(above, [*group, "block"]).select(*group, *more, F.inline(F.transform("rows", node)))
        if k == 0:
            return made
        above = made.select(*group, *more, F.col("place").alias("block"), "path")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", received: dict[str, Column] | None = None) -> DataFrame:
    """Hash tree over the rows of ``docs``: a leaf a row, a subtree a group, a root over the groups.

    Returns ``key``, ``leaf``, ``received_leaf`` (of the row with the ``received`` expressions in
    place of its fields), ``subroot``, ``root`` and ``path``, the proof: an array of (left, right)
    strings of sibling digests, from the leaf over its subtree to the root.

    Leaves ascend by key, groups by name, null first in both. Rows of an equal or null key are
    ordered by their digests. Nulls hash as ``-``, empty texts as ``0:``. Columns not named in
    ``fields`` have no part, whatever their names. An empty table gives no rows. No block holds
    more than 243 nodes, so no group is in one task, and a table of n rows takes log n to base
    243 tiers; the numbers of blocks are all that the driver sees.
    """
    new = received or {}
    rows = docs.select(
        F.col(group).isNotNull().alias("named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col(key).alias("id"),
        leaf([F.col(c) for c in fields]).alias("h"), leaf([new.get(c, F.col(c)) for c in fields]).alias("other"),
    )
    group_cols, keep = ["named", "name"], ["id", "other"]
    rows = cut(rows.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other"))), "leaves")
    lower = tiers(numbered(rows, group_cols, ["id", "h"]), group_cols, keep)
    subroots = lower[-1].select(*group_cols, F.col("root").alias("h"))
    upper = tiers(numbered(subroots, [], group_cols), [], group_cols)
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = upper[-1].select("block", none.alias("path"), "root")
    tops = descended(upper, [], top, group_cols).select(*group_cols, F.lit(0).cast("long").alias("block"), "path", "root", F.col("h").alias("subroot"))
    found = descended(lower, group_cols, tops, keep)
    return found.select(F.col("id").alias(key), F.col("h").alias("leaf"), F.coalesce("other", "h").alias("received_leaf"), "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_text(path: Column) -> Column:
    """All sibling digests of a path, from the leaf upward, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def even_id(key: str = "doc_id") -> Column:
    """Whether 2 divides the CRC-32 of the id's decimal text; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 2 == 0, F.lit(False))


_CRC = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT)"""
_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"

#: DuckDB SQL of the op13 query: trees level by level, proofs and folds leaf by leaf.
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, text, {_LEAF} AS leaf, CASE WHEN coalesce(xor({_CRC}, 4294967295) % 2 = 0, false) THEN {_LEAF.replace("(text)::", "(replace(text, chr(10), ''))::")} ELSE {_LEAF} END AS other,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM documents),
t AS (SELECT g, 0 AS lv, k, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d
  UNION ALL SELECT g, lv + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY g, lv, k // 3),
s AS MATERIALIZED (SELECT g, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, g AS k, h, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL SELECT lv + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, k // 3),
a AS MATERIALIZED (SELECT g, lv, t.k AS k, coalesce(string_agg(o.h, '' ORDER BY o.k) FILTER (o.k < t.k), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.k) FILTER (o.k > t.k), '') AS r FROM t JOIN t o USING (g, lv) WHERE t.n > 1 AND o.k // 3 = t.k // 3 GROUP BY ALL),
b AS MATERIALIZED (SELECT lv, u.k, coalesce(string_agg(o.h, '' ORDER BY o.k) FILTER (o.k < u.k), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.k) FILTER (o.k > u.k), '') AS r FROM u JOIN u o USING (lv) WHERE u.n > 1 AND o.k // 3 = u.k // 3 GROUP BY ALL),
w AS (SELECT doc_id, leaf, other, d.g, lv, l, r FROM d JOIN a ON a.g = d.g AND a.k = d.k // CAST(pow(3, lv) AS BIGINT)
  UNION ALL SELECT doc_id, leaf, other, d.g, 1000 + lv, l, r FROM d JOIN b ON b.k = d.g // CAST(pow(3, lv) AS BIGINT)),
p AS MATERIALIZED (SELECT d.doc_id, d.leaf, d.other, d.g, coalesce(list({{'l': l, 'r': r}} ORDER BY lv) FILTER (lv IS NOT NULL), []) AS path FROM d LEFT JOIN w USING (doc_id, leaf) GROUP BY ALL),
f AS (SELECT doc_id, leaf, 0 AS i, other AS h, path FROM p UNION ALL SELECT doc_id, leaf, i + 1, sha256(path[i + 1].l || h || path[i + 1].r), path FROM f WHERE i < len(path))
SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(p.path, lambda x: x.l || x.r), '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s USING (g) JOIN f ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.i = len(p.path)"""
