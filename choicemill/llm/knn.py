"""Exact top-k search by inner product: a KD-tree per shard, best boxes first.

Vectors are whole numbers, dealt to shards of about SHARD by a hash of id and vector. Each shard is split at
medians into leaves, and every node keeps the tight box of its points. For a query q, no point of a box
can score more than sum of max(q_i * low_i, q_i * high_i). Subtrees below the kth best score so far
are left out, the rest are visited by falling bound until the next bound is below that score.

Queries go in blocks of BLOCK. In round r, block b visits shard b + r (mod the number of shards), all blocks at
once, and carries its best k and so its kth score on to the next. Equal scores go to the smaller id, so
boxes with a bound equal to the kth score are visited too. Results are exact.

Defined cases: vectors that are null or hold a null or a value that is not finite take no part; shorter
vectors count as filled up with zeros; rows with the query's id are not its candidates; repeated rows of
a candidate are listed each; of several query vectors with one id the smallest is answered; null ids take no
part. Scores are exact in 64 bits; where one may not fit, the query fails.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import stage

SHARD = 32_768
BLOCK = 1_024
LEAF = 256
NONE = np.iinfo(np.int64).min


def quantised(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * component) as whole numbers, of usable vectors alone."""
    x = F.col("embedding")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, whole numbers both, without rounding.

    In doubles where every sum stays below 2^53, else in 64-bit integers; beyond those it is an error.
    """
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 2.0 ** 53:
        return np.rint(a @ b.T).astype(np.int64)
    if reach >= 2.0 ** 62:
        raise OverflowError("a score may not fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(column, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def split(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, int]:
    """Order of the points by leaf, and the depth: 2 ** depth leaves of nearly equal size.

    Each part is halved at the median of the coordinate in which it is widest.
    """
    depth = max(0, math.ceil(math.log2(max(1, len(points)) / leaf)))
    parts = [np.argsort(ids, kind="stable")]
    for _ in range(depth):
        halves = []
        for part in parts:
            axis = int(np.ptp(points[part], axis=0).argmax()) if len(part) else 0
            order = part[np.argsort(points[part, axis], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2:]]
        parts = halves
    return np.concatenate(parts), depth


def cuts(n: int, depth: int) -> np.ndarray:
    """Bounds of the leaves of n points after ``depth`` halvings."""
    sizes = [n]
    for _ in range(depth):
        sizes = [x for s in sizes for x in (s // 2, s - s // 2)]
    return np.append(0, np.cumsum(sizes))


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, depth: int):
        self.points, self.ids, self.depth = points, ids, depth
        self.cuts = cuts(len(points), depth)
        low = [points[s:e].min(axis=0) if e > s else np.zeros(points.shape[1]) for s, e in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        high = [points[s:e].max(axis=0) if e > s else np.zeros(points.shape[1]) for s, e in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.boxes = [(np.array(low), np.array(high))]
        while len(self.boxes[0][0]) > 1:
            low, high = self.boxes[0]
            self.boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))

    def bounds(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Upper bound of each leaf for each query; NONE below a box that cannot matter."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        alive = np.ones((len(queries), 1), bool)
        for low, high in self.boxes:
            bound = product(up, high) + product(down, low)
            alive = alive if alive.shape[1] == bound.shape[1] else np.repeat(alive, 2, axis=1)
            alive &= bound >= kth[:, None]
        return np.where(alive, bound, NONE)


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Improve the best k (ids, scores by falling score, then id) of each query with a tree's points."""
    k = scores.shape[1]
    bound = tree.bounds(queries, scores[:, -1])
    order = np.argsort(-np.maximum(bound, NONE + 1), axis=1, kind="stable")
    for step in range(bound.shape[1]):
        leaf = order[:, step]
        best = bound[np.arange(len(queries)), leaf]
        going = np.flatnonzero((best > NONE) & (best >= scores[:, -1]))
        if not len(going):
            return
        for node in np.unique(leaf[going]):
            rows = going[leaf[going] == node]
            s, e = tree.cuts[node], tree.cuts[node + 1]
            if s == e:
                continue
            found = product(queries[rows], tree.points[s:e])
            found[own[rows, None] == tree.ids[None, s:e]] = NONE
            better = found.max(axis=1) >= np.maximum(scores[rows, -1], NONE + 1)
            rows, found = rows[better], found[better]
            if not len(rows):
                continue
            names = np.concatenate([ids[rows], np.broadcast_to(tree.ids[s:e], found.shape)], axis=1)
            values = np.concatenate([scores[rows], found], axis=1)
            pick = np.lexsort((names, -np.maximum(values, NONE + 1)), axis=1)[:, :k]
            ids[rows], scores[rows] = np.take_along_axis(names, pick, 1), np.take_along_axis(values, pick, 1)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8" if x.dtype.kind == "f" else "<i8").tobytes()


def _plant(width: int):
    def run(key, rows):
        points, ids = _matrix(rows.column("v"), width), rows.column("vec_id").to_numpy()
        order, depth = split(points, ids)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "points": [_blob(points[order])],
                         "names": [_blob(ids[order])], "depth": pa.array([depth], pa.int32())})
    return run


def _block(width: int, k: int):
    def run(key, rows):
        n = rows.num_rows
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "queries": [_blob(_matrix(rows.column("v"), width))],
                         "own": [_blob(rows.column("vec_id").to_numpy())],
                         "ids": [_blob(np.full((n, k), np.iinfo(np.int64).max))], "scores": [_blob(np.full((n, k), NONE))]})
    return run


def _visit(width: int, k: int):
    def run(key, rows):
        out = {c: [] for c in ("block", "queries", "own", "ids", "scores")}
        for r in rows.to_pylist():
            def ints(c, r=r):
                return np.frombuffer(r[c], "<i8")
            tree = Tree(np.frombuffer(r["points"]).reshape(-1, width), ints("names"), r["depth"])
            ids, scores = ints("ids").reshape(-1, k).copy(), ints("scores").reshape(-1, k).copy()
            search(tree, np.frombuffer(r["queries"]).reshape(-1, width), ints("own"), ids, scores)
            for c, v in zip(out, (r["block"], r["queries"], r["own"], _blob(ids), _blob(scores)), strict=True):
                out[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c == "block" else pa.binary()) for c, v in out.items()})
    return run


def _listing(k: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["own"], "<i8")
                ids, scores = (np.frombuffer(r[c], "<i8").reshape(-1, k) for c in ("ids", "scores"))
                real = scores > NONE
                q, place = np.nonzero(real)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[q]), pa.array((place + 1).astype(np.int32)), pa.array(ids[real]), pa.array(scores[real])],
                    ["query_id", "rank", "vec_id", "score"])
    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (vec_id, v)."""
    vectors, queries = stage(vectors), stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    n, wide = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    m, wider = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(wide or 0, wider or 0, 1)
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(m / block))
    trees = stage(vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
                  .groupBy("shard").applyInArrow(_plant(width), "shard int, points binary, names binary, depth int"))
    state = "block int, queries binary, own binary, ids binary, scores binary"
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    best = stage(blocked.groupBy("block").applyInArrow(_block(width, k), state))
    for turn in range(shards):
        met = best.withColumn("shard", F.pmod(F.col("block") + turn, F.lit(shards)).cast("int"))
        # A shard without vectors leaves its block as it is.
        joined = met.join(trees, "shard", "left").withColumns({
            "points": F.coalesce("points", F.lit(b"")), "names": F.coalesce("names", F.lit(b"")), "depth": F.coalesce("depth", F.lit(0))})
        best = stage(joined.groupBy("block").applyInArrow(_visit(width, k), state))
    return best.select("own", "ids", "scores").mapInArrow(_listing(k), "query_id long, rank int, vec_id long, score long")


def op9_exact_knn(spark, sf_dir):
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
