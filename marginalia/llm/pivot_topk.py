"""Exact inner-product top-k: pivot distances bound the scores, best bounds come first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut

#: Rows of a candidate block and of a query block; each pair of blocks is one task's group.
CANDIDATES, QUERIES = 2048, 1024
#: Pivots, chosen farthest first from this many rows.
PIVOTS, SAMPLE = 64, 1024
#: Cells up to which their sizes (some 30 bytes each) go to every task.
SMALL = 100_000


def farthest_first(rows: np.ndarray, k: int) -> np.ndarray:
    """k rows, each the farthest from those before it."""
    at = [int(np.argmax((rows**2).sum(1)))]
    near = ((rows - rows[at[0]]) ** 2).sum(1)
    while len(at) < min(k, len(rows)) and near.max() > 0:
        at.append(int(np.argmax(near)))
        near = np.minimum(near, ((rows - rows[at[-1]]) ** 2).sum(1))
    return rows[at]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def upper(qq: np.ndarray, xx: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Most that an inner product can be, by squared norms and a lower bound of the distance.
    Scores are whole numbers; half a unit and a share cover rounding."""
    bound = (qq[:, None] + xx - low**2) / 2
    return bound + 0.5 + 1e-9 * np.abs(bound)


def block_topk(q_ids, q, q_far, ids, x, far, k: int, least: np.ndarray | None = None):
    """Each query's k best rows of a block, evaluated in the order of their bounds.

    |q - x| is at least the largest difference of their distances to a pivot, which bounds the
    score from above. Rows whose bound stays below ``least``, a score that k rows elsewhere
    reach, are out; evaluation ends once k scores are known that no bound reaches. Returns
    (query id, ids, scores) and the number of rows evaluated.
    """
    least = np.full(len(q), -np.inf) if least is None else least
    low = np.zeros((len(q), len(x)))
    for p in range(far.shape[1]):
        np.maximum(low, np.abs(q_far[:, p, None] - far[None, :, p]), out=low)
    bound = upper((q**2).sum(1), (x**2).sum(1), low)
    out, seen = [], 0
    for i in range(len(q)):
        order = np.flatnonzero(bound[i] >= least[i])
        order = order[np.argsort(-bound[i, order])]
        best_s, best_i = np.empty(0), np.empty(0, np.int64)
        s, step = 0, 64
        while s < len(order):
            if len(best_s) == k and bound[i, order[s]] < best_s[-1]:
                break
            part = order[s : s + step]
            part = part[ids[part] != q_ids[i]]
            score = x[part] @ q[i]
            seen += len(part)
            all_s, all_i = np.concatenate([best_s, score]), np.concatenate([best_i, ids[part]])
            top = np.lexsort((all_i, -all_s))[:k]
            best_s, best_i = all_s[top], all_i[top]
            s, step = s + step, min(2 * step, 512)
        out.append((q_ids[i], best_i, best_s))
    return out, seen


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products over all other rows.

    Vectors are floor(scale * x). Queries are the rows whose id ``every`` divides; rows of the
    query's id are its own. Vectors that are null, empty or hold null or non-finite components
    take no part; only vectors of one length are compared. Repeated rows are candidates each;
    of the rows of a repeated query the least vector asks. Equal scores go to the smaller id.
    Null ids take no part, extra columns are not read, an empty table gives no rows.

    Rows are dealt into blocks by their nearest pivot. A first pass over each block gives its
    range of distances to every pivot and, for the queries in it, a score that k rows reach.
    Query blocks then go only to the blocks whose range lets some row reach a query's score,
    and there only rows with such a bound are evaluated. Nothing is broadcast but the pivots
    and, by a checked number, the sizes of the pivots' cells.
    """
    v = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"))
    rows = rows.withColumn("dim", F.size("x"))
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["x"])
    pivots = {d: farthest_first(np.array(xs), PIVOTS) for d, xs in sample.items()}

    def far(x: np.ndarray) -> np.ndarray:
        return pivot_distances(x, pivots.get(x.shape[1], np.empty((0, x.shape[1]))))

    def nearest(frames):
        for f in frames:
            cell = np.zeros(len(f), np.int32)
            for d, at in f.groupby("dim").indices.items():
                if d in pivots:
                    cell[at] = far(_stack(f["x"].iloc[at])).argmin(1)
            yield f.assign(cell=cell)

    table = cut(rows.mapInPandas(nearest, "id long, x array<double>, dim int, cell int"), "topk-cells")
    ask = F.col("id") % every == 0
    cells = table.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("c"), F.ceil(F.count_if(ask) / QUERIES).alias("q"))
    if cells.limit(SMALL + 1).count() <= SMALL:
        cells = F.broadcast(cells)
    place = lambda n: F.concat_ws("-", "cell", F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))))
    dealt = table.join(cells, ["dim", "cell"]).select("id", "x", "dim", place("c").alias("cb"), F.when(ask, place("q")).alias("qb"))

    def survey(f: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stack(f["x"]), f["id"].to_numpy()
        d, mine = far(x), np.unique(ids[ids % every == 0])
        least = []
        for i in mine:
            own = [np.sort(x[ids != i] @ y)[::-1] for y in x[ids == i]]
            least.append(min(s[k - 1] if len(s) >= k else -np.inf for s in own))
        return pd.DataFrame({"dim": f["dim"].iloc[:1], "cb": f["cb"].iloc[:1], "low": [d.min(0)], "high": [d.max(0)], "big": [(x**2).sum(1).max()], "asked": [mine], "least": [np.array(least)]})

    found = dealt.groupBy("dim", "cb").applyInPandas(survey, "dim int, cb string, low array<double>, high array<double>, big double, asked array<long>, least array<double>")
    blocks = cut(found, "topk-blocks")
    known = blocks.select(F.explode(F.arrays_zip("asked", "least")).alias("z")).groupBy(F.col("z.asked").alias("id")).agg(F.min("z.least").alias("least"))
    queries = dealt.where("qb is not null").groupBy("id").agg(F.min(F.struct("x", "dim", "qb")).alias("r")).select("id", "r.*").join(known, "id")
    queries = cut(queries, "topk-queries")
    chunks = max(1, -(-blocks.count() // CANDIDATES))
    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    ranges = blocks.select("dim", "cb", "low", "high", "big", F.pmod(F.xxhash64("cb"), F.lit(chunks)).cast("int").alias("chunk"))
    ranges = ranges.join(queries.select("dim", "qb").distinct().toDF("dim", "qb"), "dim")

    def reach(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame({"dim": [], "qb": [], "cb": []})
        q, lo, hi, some = _stack(qs["x"]), _stack(bs["low"]), _stack(bs["high"]), np.zeros(len(bs), bool)
        for s in range(0, len(q), 128):
            d, low = far(q[s : s + 128]), np.zeros((len(q[s : s + 128]), len(bs)))
            for p in range(d.shape[1]):
                np.maximum(low, np.maximum(lo[:, p] - d[:, p, None], d[:, p, None] - hi[:, p]), out=low)
            some |= (upper((q[s : s + 128] ** 2).sum(1), bs["big"].to_numpy(), low) >= qs["least"].to_numpy()[s : s + 128, None]).any(0)
        return bs.loc[some, ["dim", "qb", "cb"]]

    asked = queries.select("*", chunk)
    pairs = asked.groupBy("dim", "qb", "chunk").cogroup(ranges.groupBy("dim", "qb", "chunk")).applyInPandas(reach, "dim int, qb string, cb string")
    pairs = cut(pairs, "topk-pairs")

    def search(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(qs):
            x, ids = _stack(xs["x"]), xs["id"].to_numpy()
            d = far(x)
            for s in range(0, len(qs), 256):
                p = qs.iloc[s : s + 256]
                q = _stack(p["x"])
                out += block_topk(p["id"].to_numpy(), q, far(q), ids, x, d, k, p["least"].to_numpy())[0]
        out = [(a, b, int(score)) for a, ids, scores in out for b, score in zip(ids, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["dim", "qb", "cb"]
    c = dealt.select("id", "x", "dim", "cb").join(pairs, ["dim", "cb"])
    q = queries.join(pairs.toDF(*pairs.columns), ["dim", "qb"])
    part = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
