"""Boosted regression trees grown from histograms, for all fits of a grid at once.

The method is that of Spark ML's ``GBTRegressor`` (squared error, 32 quantile bins, the first tree with weight 1,
later ones on twice the residual with the step as weight), which starts several jobs for every tree of every fit. Here
features are binned once for all fits, and bins, weights and targets are one byte block per partition.

Where the binned queries are few (``LOCAL_CELLS``), every task holds them and grows whole fits. Beyond that, queries
stay in their blocks: a round is one job per level for all fits together, in which blocks send histograms only.
Sums are whole numbers, and rows and columns are drawn by hash, so both forms give the same trees wherever rows lie.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicemill.params import Params
from choicemill.session import checkpoint_root

BINS = 32  # bins of a feature, as in Spark ML
LOCAL_CELLS = 20_000_000  # queries x features that a task may hold, a byte each
BLOCK_CELLS = 5_000_000  # the same of a block, which also has a prediction per fit
CHUNK = 4_096  # rows that are counted at a time
GRID = 24  # gradients are whole multiples of 2^-24 of the largest target, squared errors of 2^-36 of its square
CUT_ROUNDS = 50  # rounds after which the blocks' predictions are written, which ends their lineage
NEVER = 255  # the cut of a node that is not split: every bin goes left


class Block(NamedTuple):
    """Queries of a partition: binned features, keys for draws, targets, and members' weights (none in validation)."""

    bins: np.ndarray
    keys: np.ndarray
    y: np.ndarray
    w: np.ndarray


class Layout:
    """Where the bins of each feature lie in a histogram, and the unit of gradients."""

    def __init__(self, cuts: Sequence[np.ndarray], largest: float):
        sizes = np.array([len(c) + 1 for c in cuts])
        self.cuts, self.width = list(cuts), len(cuts)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.total, self.first = int(sizes.sum()), int(sizes[0])
        self.feature = np.repeat(np.arange(self.width), sizes - 1)  # of each possible split
        self.bin = np.concatenate([np.arange(s - 1) for s in sizes]).astype(np.int64)
        self.scale = 2.0 ** np.ceil(np.log2(largest)) if largest > 0 else 1.0
        self.unit, self.error_unit = self.scale * 2.0 ** -GRID, self.scale ** 2 * 2.0 ** -36


class Fit(NamedTuple):
    """One fit of the grid: its target and member by position, and its seed."""

    target: int
    member: int
    seed: int


class Tree:
    """A tree in heap order, always of full depth: below a node that is not split, all goes left to the same value."""

    def __init__(self, depth: int):
        inner = 2 ** depth - 1
        self.feature, self.cut = np.zeros(inner, np.int64), np.full(inner, NEVER, np.int64)
        self.value = np.zeros(2 * inner + 1)

    def placed(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = self.down(bins, at, row)
        return at

    def down(self, bins: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return 2 * at + 1 + (bins[row, self.feature[at]] > self.cut[at])


# ---------------------------------------------------------------- draws

def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, turn: int) -> np.ndarray:
    return _mixed(np.array([(seed << 32) + turn + 1], np.uint64))


def drawn_rows(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Whether a tree takes a row: by the row's key, so wherever the row lies."""
    if share >= 1:
        return np.ones(len(keys), bool)
    return _mixed(keys ^ _stream(seed, turn)) < np.uint64(int(share * 2.0 ** 64))


def drawn_columns(nodes: np.ndarray, width: int, seed: int, turn: int, share: float) -> np.ndarray:
    """Which features each node may split on: nodes x features."""
    kept = min(width, int(np.ceil(share * width)))
    if kept == width:
        return np.ones((len(nodes), width), bool)
    own = _mixed(_stream(seed, turn) ^ (nodes.astype(np.uint64) + np.uint64(1)))
    lots = _mixed(own[:, None] + np.arange(width, dtype=np.uint64)[None])
    out = np.zeros((len(nodes), width), bool)
    np.put_along_axis(out, np.argsort(lots, axis=1, kind="stable")[:, :kept], True, axis=1)
    return out


# ---------------------------------------------------------------- histograms and splits

def histogram(bins: np.ndarray, w: np.ndarray, g: np.ndarray, slot: np.ndarray, slots: int, layout: Layout) -> np.ndarray:
    """Sums of weights and gradients per (slot, bin of a feature): 2 x slots x bins, whole numbers.

    Both sums come from one count: a weight stands above its gradient in the 53 bits of a double. Rows are split
    further where these do not hold the sums.
    """
    size = slots * layout.total
    out = np.zeros((2, size), np.int64)
    todo = [(a, min(a + CHUNK, len(w))) for a in range(0, len(w), CHUNK)]
    while todo:
        a, b = todo.pop()
        shift = 52 - int(w[a:b].sum()).bit_length()
        if 2 * int(np.abs(g[a:b]).sum()) >= 1 << shift:
            if b - a == 1:
                raise ValueError("a residual is too large for its targets")
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            continue
        flat = np.add(bins[a:b], layout.starts, dtype=np.int64)
        if slots > 1:
            flat += (slot[a:b] * layout.total)[:, None]
        both = np.ldexp(w[a:b].astype(float), shift) + g[a:b]
        sums = np.bincount(flat.ravel(), np.repeat(both, layout.width), size)
        weights = np.rint(np.ldexp(sums, -shift))
        out[0] += weights.astype(np.int64)
        out[1] += (sums - np.ldexp(weights, shift)).astype(np.int64)
    return out.reshape(2, slots, layout.total)


class Splits(NamedTuple):
    """Per node: whether it is split, feature, cut, sums (weight, gradient) of the node and of its left side."""

    split: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    node: np.ndarray
    left: np.ndarray


NO_SPLITS = Splits(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64))


def best_splits(sums: np.ndarray, nodes: np.ndarray, fit: Fit, turn: int, layout: Layout, params: Params) -> Splits:
    """The split of each node that lowers the squared error most; of equal ones the first."""
    node = sums[:, :, :layout.first].sum(axis=2)
    none = np.zeros(len(nodes), np.int64)
    if not len(layout.feature):
        return Splits(none > 0, none, none + NEVER, node, node)
    before = np.zeros((2, len(nodes), layout.total + 1), np.int64)
    np.cumsum(sums, axis=2, out=before[:, :, 1:])
    start = layout.starts[layout.feature]
    left = before[:, :, start + layout.bin + 1] - before[:, :, start]
    right = node[:, :, None] - left
    allowed = drawn_columns(nodes, layout.width, fit.seed, turn, params.boost_columns)[:, layout.feature]
    allowed &= (left[0] >= params.boost_leaf) & (right[0] >= params.boost_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left[1].astype(float) ** 2 / left[0] + right[1].astype(float) ** 2 / right[0]
        whole = np.where(node[0] > 0, node[1].astype(float) ** 2 / node[0], 0.0)
    score = np.where(allowed, score, -np.inf)
    best = score.argmax(axis=1)
    row = np.arange(len(nodes))
    top = score[row, best]
    split = np.isfinite(top) & (top - whole > 1e-12 * top)
    return Splits(split, layout.feature[best], layout.bin[best], node, left[:, row, best])


def take_splits(tree: Tree, nodes: np.ndarray, found: Splits, level: int, layout: Layout) -> np.ndarray:
    """Enter the splits of a level into the tree; returns the split nodes."""

    def mean(sums: np.ndarray) -> np.ndarray:
        return np.where(sums[0] > 0, sums[1] * layout.unit / np.maximum(sums[0], 1), 0.0)

    if level == 0:
        tree.value[0] = mean(found.node)[0]
    here = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
    tree.value[2 * here + 1] = tree.value[2 * here + 2] = tree.value[here]
    done = nodes[found.split]
    tree.feature[done], tree.cut[done] = found.feature[found.split], found.cut[found.split]
    tree.value[2 * done + 1] = mean(found.left[:, found.split])
    tree.value[2 * done + 2] = mean((found.node - found.left)[:, found.split])
    return done


def smaller(done: np.ndarray, found: Splits) -> np.ndarray:
    """The child of each split node with the smaller weight; the other one's sums are the parent's less its own."""
    return 2 * done + 1 + (2 * found.left[0, found.split] > found.node[0, found.split])


def gradients(w: np.ndarray, y: np.ndarray, predicted: np.ndarray, turn: int, layout: Layout) -> np.ndarray:
    """Weighted targets of a tree, in whole units: the target itself, then twice the residual."""
    return np.rint(w * (y if turn == 0 else 2 * (y - predicted)) / layout.unit).astype(np.int64)


def tree_weight(turn: int, params: Params) -> float:
    return 1.0 if turn == 0 else params.boost_step


def squared_errors(y: np.ndarray, predicted: np.ndarray, layout: Layout) -> int:
    return int(np.rint((y - predicted) ** 2 / layout.error_unit).astype(np.int64).sum())


class Patience:
    """Errors on validation so far, and whether the rounds without improvement are used up."""

    def __init__(self, params: Params):
        self.errors: list[float] = []
        self.best, self.kept, self.rounds, self.patience = float("inf"), 0, params.boost_rounds, params.boost_patience

    def goes_on(self, error: float) -> bool:
        self.errors.append(error)
        if error < self.best:
            self.best, self.kept = error, len(self.errors)
        return len(self.errors) < self.rounds and len(self.errors) - self.kept < self.patience


class Fitted(NamedTuple):
    """The kept trees: features and thresholds by node, values of the last level times the tree's weight; the error."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    error: float


def fitted(trees: Sequence[Tree], patience: Patience, layout: Layout, params: Params) -> Fitted:
    kept = trees[:patience.kept]
    threshold = [[layout.cuts[f][c] if c != NEVER else np.inf for f, c in zip(t.feature, t.cut, strict=True)] for t in kept]
    leaves = 2 ** params.boost_depth - 1
    return Fitted(np.array([t.feature for t in kept], np.int32), np.array(threshold, float),
                  np.array([tree_weight(i, params) * t.value[leaves:] for i, t in enumerate(kept)]), patience.best)


# ---------------------------------------------------------------- a whole fit in a task

def grown(train: Block, valid: Block, fit: Fit, layout: Layout, params: Params) -> Fitted:
    """One fit on queries that the task holds."""
    mine = train.w[:, fit.member] > 0
    bins, keys, y, w = train.bins[mine], train.keys[mine], train.y[mine, fit.target], train.w[mine, fit.member].astype(np.int64)
    row, predicted = np.arange(len(y)), np.zeros(len(y))
    found, done = NO_SPLITS, NO_SPLITS.feature
    held, held_out = valid.y[:, fit.target], np.zeros(len(valid.y))
    trees, patience, goes_on = [], Patience(params), True
    while goes_on:
        turn, tree = len(trees), Tree(params.boost_depth)
        drawn = drawn_rows(keys, fit.seed, turn, params.boost_rows)
        g, at, nodes = gradients(w, y, predicted, turn, layout), np.zeros(len(y), np.int64), np.zeros(1, np.int64)
        sums = histogram(bins[drawn], w[drawn], g[drawn], at[drawn], 1, layout)
        for level in range(params.boost_depth):
            if level:
                small = smaller(done, found)
                slot = np.full(2 * len(tree.feature) + 1, -1)
                slot[small] = np.arange(len(small))
                some = np.flatnonzero(drawn & (slot[at] >= 0))
                less = histogram(bins[some], w[some], g[some], slot[at[some]], len(small), layout)
                nodes = np.concatenate([small, 4 * done + 3 - small])
                sums = np.concatenate([less, sums[:, found.split] - less], axis=1)
            found = best_splits(sums, nodes, fit, turn, layout, params)
            done = take_splits(tree, nodes, found, level, layout)
            at = tree.down(bins, at, row)
        step = tree_weight(turn, params)
        predicted += step * tree.value[at]
        held_out += step * tree.value[tree.placed(valid.bins, params.boost_depth)]
        trees.append(tree)
        goes_on = patience.goes_on(squared_errors(held, held_out, layout) * layout.error_unit / len(held))
    return fitted(trees, patience, layout, params)


# ---------------------------------------------------------------- fits over blocks

class Part(NamedTuple):
    """A block with its predictions so far, a column per fit."""

    block: Block
    predicted: np.ndarray


class Open(NamedTuple):
    """A tree so far and the nodes of its lowest level: those to count, then the others of each pair; and which of
    the nodes above were split."""

    tree: Tree
    counted: np.ndarray
    nodes: np.ndarray
    split: np.ndarray


def _level_sums(part: Part, fits: dict, trees: dict, turn: int, level: int, layout: Layout, params: Params) -> Iterator:
    """(fit, (sums, None)) of the counted nodes of a level, from a block's drawn rows."""
    block = part.block
    for i, (tree, counted, _, _) in trees.items():
        fit = fits[i]
        w = block.w[:, fit.member]
        some = np.flatnonzero((w > 0) & drawn_rows(block.keys, fit.seed, turn, params.boost_rows))
        slot = np.full(2 * len(tree.feature) + 1, -1)
        slot[counted] = np.arange(len(counted))
        bins = block.bins[some]
        at = slot[tree.placed(bins, level)]
        here = at >= 0
        some, w = some[here], w[some[here]].astype(np.int64)
        g = gradients(w, block.y[some, fit.target], part.predicted[some, i], turn, layout)
        yield i, (histogram(bins[here], w, g, at[here], len(counted), layout), None)


def _added(a: tuple, b: tuple) -> tuple:
    """Sums of blocks add up; those of the level above come once."""
    return tuple(y if x is None else x if y is None else x + y for x, y in zip(a, b, strict=True))


def _with_others(sums: tuple) -> np.ndarray:
    """Sums of the counted nodes, then of the others: their parents' less those."""
    less, above = sums
    return less if above is None else np.concatenate([less, above - less], axis=1)


def _moved(part: Part, trees: dict, turn: int, params: Params) -> Part:
    """The block with the predictions of one more tree a fit."""
    predicted = part.predicted.copy()
    for i, tree in trees.items():
        predicted[:, i] += tree_weight(turn, params) * tree.value[tree.placed(part.block.bins, params.boost_depth)]
    return Part(part.block, predicted)


def _written(parts: RDD, folder: str, before: str | None) -> tuple[RDD, str]:
    """Parts written to the shared folder and read back, in place of those written before."""
    sc = parts.context
    path = f"{folder}/{uuid.uuid4().hex}"
    parts.saveAsPickleFile(path, 1)
    if before:
        old = sc._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)
    return sc.pickleFile(path), path


def grown_in_blocks(train: DataFrame, valid: DataFrame, fits: Sequence[Fit], layout: Layout, params: Params) -> list[Fitted]:
    """All fits round by round: a job for each level, then one that moves the predictions and takes the errors."""
    spark = train.sparkSession
    sc, all_fits = spark.sparkContext, dict(enumerate(fits))

    def parts_of(blocks: DataFrame) -> RDD:
        return blocks.rdd.map(lambda r: pickle.loads(bytes(r["block"]))).map(
            lambda b: Part(b, np.zeros((len(b.y), len(all_fits))))).persist(StorageLevel.MEMORY_AND_DISK)

    folder = f"{checkpoint_root(spark)}/boosting/{sc.applicationId}"
    parts = {"train": parts_of(train), "valid": parts_of(valid)}
    at = {"train": None, "valid": None}
    held = parts["valid"].map(lambda p: len(p.block.y)).sum()
    trees, patience, active = {i: [] for i in all_fits}, {i: Patience(params) for i in all_fits}, list(all_fits)
    turn = 0
    while active:
        growing, sums = {i: Tree(params.boost_depth) for i in active}, None
        root = np.zeros(1, np.int64)
        below = {i: Open(growing[i], root, root, root) for i in active}
        for level in range(params.boost_depth):
            given = sc.broadcast(below)

            def counted(part: Part, given=given, turn=turn, level=level) -> Iterator:
                return _level_sums(part, all_fits, given.value, turn, level, layout, params)

            def above(item: tuple, given=given) -> list[tuple]:
                i, total = item
                return [(i, (None, total[:, given.value[i].split]))] if i in given.value else []

            def best(item: tuple, given=given, turn=turn) -> tuple:
                i, total = item
                return i, best_splits(total, given.value[i].nodes, all_fits[i], turn, layout, params)

            found, was = {}, sums
            if below:
                rows = parts["train"].flatMap(counted)
                rows = rows if was is None else rows.union(was.flatMap(above))
                sums = rows.reduceByKey(_added, min(len(below), sc.defaultParallelism)).mapValues(_with_others).persist()
                found = dict(sums.map(best).collect())
            if was is not None and was is not sums:
                was.unpersist()
            given.unpersist()
            nodes, below = {i: o.nodes for i, o in below.items()}, {}
            for i in active:
                here = found.get(i, NO_SPLITS)
                done = take_splits(growing[i], nodes.get(i, NO_SPLITS.feature), here, level, layout)
                if len(done):
                    small = smaller(done, here)
                    below[i] = Open(growing[i], small, np.concatenate([small, 4 * done + 3 - small]), here.split)
        sums.unpersist()
        given = sc.broadcast(growing)

        def moved(part: Part, given=given, turn=turn) -> Part:
            return _moved(part, given.value, turn, params)

        def errors(part: Part, active=tuple(active)) -> list[int]:
            return [squared_errors(part.block.y[:, all_fits[i].target], part.predicted[:, i], layout) for i in active]

        for name, was in list(parts.items()):
            now = was.map(moved)
            if (turn + 1) % CUT_ROUNDS == 0:
                now, at[name] = _written(now, folder, at[name])
            parts[name] = now.persist(StorageLevel.MEMORY_AND_DISK)
            if name == "train":
                parts[name].count()
            else:
                total = parts[name].map(errors).reduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
            was.unpersist()
        still = []
        for i, error in zip(active, total, strict=True):
            trees[i].append(growing[i])
            if patience[i].goes_on(error * layout.error_unit / held):
                still.append(i)
        active, turn = still, turn + 1
    for rdd in parts.values():
        rdd.unpersist()
    return [fitted(trees[i], patience[i], layout, params) for i in all_fits]


# ---------------------------------------------------------------- from rows to fits

def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def bin_cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Thresholds of each feature, from all rows: halfway between neighbouring values, at even shares of the rows.

    With no more values than bins, every pair of neighbours has one. Equal values collapse per batch, then per feature; the
    running counts are taken by a sort that can spill.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            each = [np.unique(x[:, f], return_counts=True) for f in range(width if len(x) else 0)]
            if each:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(width, dtype=np.int32), [len(v) for v, _ in each])),
                     pa.array(np.concatenate([v for v, _ in each])), pa.array(np.concatenate([n for _, n in each]))],
                    ["feature", "value", "n"])

    counts = rows.select("x").mapInArrow(counted, "feature int, value double, n long")
    counts = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    order, group = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(
        "feature", "value", F.lag("value").over(order).alias("before"), (2 * F.sum("n").over(running) - F.col("n")).alias("twice"),
        F.sum("n").over(group).alias("rows"), F.count(F.lit(1)).over(group).alias("values"))
    bins = F.least(F.lit(BINS), F.col("rows"))
    share = F.when(F.col("before").isNull(), 0).otherwise(F.ceil(F.col("twice") / (2 * F.col("rows") / bins)) - 1)
    placed = placed.withColumn("bins", bins).withColumn("share", share)
    placed = placed.withColumn("last", F.lag("share").over(order))
    wanted = placed.filter(F.col("before").isNotNull() & ((F.col("values") <= F.col("bins")) | (F.col("share") > F.col("last"))))
    found: list[list[float]] = [[] for _ in range(width)]
    for r in wanted.select("feature", ((F.col("before") + F.col("value")) / 2).alias("cut")).collect():
        found[r["feature"]].append(r["cut"])
    return [np.array(sorted(c)) for c in found]


def blocks(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """One binary row per partition: its queries as a pickled Block."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column("x"), width)
            bins = np.empty((n, width), np.uint8)
            for f, c in enumerate(cuts):
                bins[:, f] = np.searchsorted(c, x[:, f], side="left")
            wide = {name: len(batch.column(name).flatten()) // n if n else 0 for name in ("y", "w")}
            parts.append(Block(bins, batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64),
                               _matrix(batch.column("y"), wide["y"]), _matrix(batch.column("w"), wide["w"]).astype(np.uint8)))
        if parts := [p for p in parts if len(p.y)]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(joined(parts))], pa.binary())], ["block"])

    return rows.mapInArrow(run, "block binary")


def joined(parts: Sequence[Block]) -> Block:
    return Block(*[np.concatenate(columns) for columns in zip(*parts, strict=True)])


def fit_all(train: DataFrame, valid: DataFrame, width: int, fits: Sequence[Fit], params: Params) -> list[Fitted]:
    """Fit every (target, member) of ``fits`` on rows of query_id, features, y and, for training, w."""
    from pyspark.ml.functions import vector_to_array

    x = [F.xxhash64("query_id").alias("key"), vector_to_array("features").alias("x"), "y"]
    train = train.select(*x, F.col("w").cast("array<int>").alias("w")).persist()
    valid = valid.select(*x, F.array().cast("array<int>").alias("w"))
    checks = [F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("y", F.abs))).alias("largest"),
              F.count(F.when(F.exists("y", lambda v: v.isNull() | F.isnan(v)), 1)).alias("missing")]
    members = sorted({fit.member for fit in fits})
    drew = [F.count(F.when(F.col("w")[m] > 0, 1)).alias(f"w{m}") for m in members]
    seen, held = train.agg(*checks, *drew).first(), valid.agg(*checks).first()
    if not seen["n"] or not held["n"]:
        raise ValueError("boosted trees need training and validation queries")
    if seen["missing"] or held["missing"]:
        raise ValueError("a target of the boosted trees is missing")
    if lacking := [m for m in members if not seen[f"w{m}"]]:
        raise ValueError(f"members {lacking} have no training query")
    cuts = bin_cuts(train, width)
    layout = Layout(cuts, seen["largest"])
    sc = train.sparkSession.sparkContext
    if (seen["n"] + held["n"]) * width > LOCAL_CELLS:
        inputs = [blocks(rows.coalesce(max(sc.defaultParallelism, -(-n * width // BLOCK_CELLS))), cuts)
                  for rows, n in ((train, seen["n"]), (valid, held["n"]))]
        out = grown_in_blocks(*inputs, fits, layout, params)
    else:
        inputs = blocks(train, cuts), blocks(valid, cuts)
        whole = sc.broadcast(tuple(joined([pickle.loads(bytes(r["block"])) for r in part.collect()]) for part in inputs))
        out = sc.parallelize(list(fits), len(fits)).map(lambda fit: grown(*whole.value, fit, layout, params)).collect()
        whole.unpersist()
    train.unpersist()
    return out


# ---------------------------------------------------------------- scoring

def scored(x: np.ndarray, model: Fitted) -> np.ndarray:
    """Predictions of dense feature rows: the sum of the leaves they reach."""
    trees, inner = model.feature.shape
    out, tree = np.empty(len(x)), np.arange(trees)[None]
    some = max(1, 200_000 // trees)
    for a in range(0, len(x), some):
        part = x[a:a + some]
        row, at = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
        while at[0, 0] < inner:
            at = 2 * at + 1 + (part[row, model.feature[tree, at]] > model.threshold[tree, at])
        out[a:a + some] = model.value[tree, at - inner].sum(axis=1)
    return out
