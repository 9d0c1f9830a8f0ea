"""Learners on query features: weighted ridge regression and boosted trees.

Ridge needs only weighted sums of feature products. They are built per batch inside tasks with
NumPy and added up by Spark in two levels, so the work is one pass over the training queries and the shuffle is
p x p / 2 per member and task. Fits, and fits without a feature family, come from these sums alone.
Like every linear learner it is fitted once for outcome and cost and serves all alphas.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from choicemill.functions.candidates import item
from choicemill.functions.hashing import draw_seed, draw_weight_array
from choicemill.functions.numeric import mean_of, rounded, settled_double
from choicemill.operators import boosting
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import row_bound

PLAIN = -1  # the member that holds every training query once
BLOCK_SCHEMA = "member int, part int, block binary"
PARTS = 64  # groups of the first of two merging levels
FIT_ROWS = 25_000  # queries in a partition of the boosted fits
TREES = "alpha double, member int, model string, turn int, feature array<int>, threshold array<double>, value array<double>"
TREES_ARROW = pa.schema([
    ("alpha", pa.float64()), ("member", pa.int32()), ("model", pa.string()), ("turn", pa.int32()), ("feature", pa.list_(pa.int32())),
    ("threshold", pa.list_(pa.float64())), ("value", pa.list_(pa.float64()))])


# ---------------------------------------------------------------- ridge

def packed_length(width: int, targets: int) -> int:
    """Numbers in a block: the upper triangle of a width x width matrix, then width x targets."""
    return width * (width + 1) // 2 + width * targets


def _dense(indices: pa.ListArray, values: pa.ListArray, width: int) -> np.ndarray:
    """Rows of sparse features behind a leading 1 for the intercept."""
    counts = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(counts), width))
    out[:, 0] = 1.0
    at = indices.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(counts)), counts), at + 1] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def targets_of(params: Params) -> Column:
    """The learner's targets: outcome, then normalised cost, of each candidate."""
    return F.array(*[item(i, "correct").cast("double") for i in range(params.k)], *[item(i, "normalized_cost") for i in range(params.k)])


def moment_blocks(vectors: DataFrame, features: int, params: Params = DEFAULT) -> DataFrame:
    """member, block: sums of w x x' (upper triangle) and w x y' over training queries, packed as doubles.

    x has a leading 1. Member PLAIN has weight 1 throughout, the others their bootstrap weights. A
    query goes to Python once, with its weights in an array. A task adds up its batches and gives one block a
    member; blocks are added in two levels, so no task sees those of all others.
    """
    width, targets = features + 1, 2 * params.k
    size = packed_length(width, targets)
    train = vectors.filter(F.col("split") == "train").select("query_id", "indices", "values", targets_of(params).alias("y"))
    rows = draw_weight_array(train, str(params.seed), params.members, "w").drop("query_id")
    triangle = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((params.members + 1, width, width))
        right = np.zeros((params.members + 1, width, targets))
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                some = batch.slice(at, 4_096)
                x, y = _dense(some.column("indices"), some.column("values"), width), _matrix(some.column("y"))
                weights = np.column_stack([np.ones(len(x)), _matrix(some.column("w"))])
                for m in range(params.members + 1):
                    weighted = x * weights[:, m, None]
                    gram[m] += weighted.T @ x
                    right[m] += weighted.T @ y
        part = TaskContext.get().partitionId() % PARTS
        blocks = [np.concatenate([g[triangle], r.ravel()]).tobytes() for g, r in zip(gram, right, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(PLAIN, params.members, dtype=np.int32)), pa.array(np.full(len(blocks), part, np.int32)),
             pa.array(blocks, pa.binary())], ["member", "part", "block"])

    def added(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.column("block"):
                total += np.frombuffer(block.as_buffer())
        part = key[1].as_py() if len(key) > 1 else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            ["member", "part", "block"])

    def halfway(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(key, batches)

    first = rows.mapInArrow(partial, BLOCK_SCHEMA).groupBy("member", "part").applyInArrow(halfway, BLOCK_SCHEMA)
    return first.groupBy("member").applyInArrow(halfway, BLOCK_SCHEMA).select("member", "block")


def unpacked(block: bytes, width: int, targets: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(block)
    gram = np.zeros((width, width))
    gram[np.triu_indices(width)] = flat[: width * (width + 1) // 2]
    return gram + np.triu(gram, 1).T, flat[width * (width + 1) // 2:].reshape(width, targets)


def moment_rows(blocks: DataFrame, features: int, params: Params = DEFAULT) -> DataFrame:
    """Long view of the blocks: member, i, j, value; j beyond the features is target j - width."""
    width, targets = features + 1, 2 * params.k
    i, j = np.triu_indices(width)
    i = np.concatenate([i, np.repeat(np.arange(width), targets)]).astype(np.int32)
    j = np.concatenate([j, np.tile(np.arange(width, width + targets), width)]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member, block in zip(batch.column("member"), batch.column("block"), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), member.as_py(), np.int32)), pa.array(i), pa.array(j), pa.array(np.frombuffer(block.as_buffer()))],
                    ["member", "i", "j", "value"])

    return blocks.mapInArrow(run, "member int, i int, j int, value double")


def ridge_coefficients(blocks: Iterable[tuple[int, bytes]], features: int, penalty: float = 1.0,
                       without: Sequence[tuple[int, int]] = (), params: Params = DEFAULT) -> dict[int, np.ndarray]:
    """Coefficients (intercept first) x targets per member, for features as they are, from the moments alone.

    Features are scaled to the mean and deviation of the plain training queries, and the penalty counts for
    scaled features; the intercept is free. Features in the index ranges ``without`` take no part and get 0: the
    moments of a fit without them are a part of these, so no row is read again.
    """
    width, targets = features + 1, 2 * params.k
    stored = {m: unpacked(block, width, targets) for m, block in blocks}
    gram, _ = stored[PLAIN]
    n = max(gram[0, 0], 1.0)
    mean = gram[0] / n
    spread = np.sqrt(np.maximum(np.diag(gram) / n - mean * mean, 0))
    spread[spread <= 1e-9 * np.sqrt(np.diag(gram) / n) + 1e-300] = 1.0  # a constant stays as it is
    scale = np.diag(1 / spread)
    scale[0, 0] = 1.0
    scale[1:, 0] = -mean[1:] / spread[1:]
    kept = np.array([i for i in range(width) if not any(s + 1 <= i < e + 1 for s, e in without)])
    shrink = penalty * np.eye(len(kept))
    shrink[0, 0] = 0.0
    out = {}
    for member, (gram, right) in stored.items():
        inner = (scale @ gram @ scale.T)[np.ix_(kept, kept)]
        found = np.zeros((width, targets))
        found[kept] = np.linalg.solve(inner + shrink, (scale @ right)[kept])
        out[member] = scale.T @ found
    return out


def read_blocks(blocks: DataFrame) -> list[tuple[int, bytes]]:
    """The blocks of all members: (members + 1) x features^2 / 2 numbers at any number of queries."""
    return [(r["member"], bytes(r["block"])) for r in blocks.collect()]


def with_predictions(vectors: DataFrame, coefficients: dict[int, np.ndarray], name: str = "predictions",
                     params: Params = DEFAULT) -> DataFrame:
    """Add each member's prediction: an array over members, in order, of structs (correct, cost).

    The coefficients travel with the tasks, (members x targets x features) numbers; a row's features meet those of all
    members in one product, and nothing is shuffled.
    """
    members = sorted(coefficients)
    table = np.concatenate([coefficients[m] for m in members], axis=1)
    k = params.k
    kind = pa.struct([("correct", pa.list_(pa.float64())), ("cost", pa.list_(pa.float64()))])

    def lists(values: np.ndarray, length: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, length, dtype=np.int32)), pa.array(values.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _dense(batch.column("indices"), batch.column("values"), len(table)) @ table
            found = found.reshape(batch.num_rows, len(members), 2 * k)
            both = pa.StructArray.from_arrays([lists(found[:, :, :k], k), lists(found[:, :, k:], k)], fields=list(kind))
            whole = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(both) + 1, len(members), dtype=np.int32)), both)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], [*batch.schema.names, name])

    schema = StructType([*vectors.schema.fields, StructField(name, ArrayType(StructType([
        StructField("correct", ArrayType(DoubleType())), StructField("cost", ArrayType(DoubleType()))])))])
    return vectors.mapInArrow(run, schema)


# ---------------------------------------------------------------- boosted trees

def best_iteration(errors: Sequence[float], patience: int) -> int:
    """Iterations to keep: the best one before ``patience`` iterations without improvement."""
    best, kept = float("inf"), 0
    for i, error in enumerate(errors):
        if error < best:
            best, kept = error, i + 1
        elif i + 1 - kept >= patience:
            break
    return kept


def model_path(path: str, alpha: float, member: int, model: str) -> str:
    return f"{path}/alpha={alpha}/member={member}/model={model}"


def first_rounds(model, rounds: int):
    """A fitted ensemble of trees cut to its first rounds; a boosted fit of fewer rounds is just that."""
    from pyspark.ml.regression import GBTRegressionModel

    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    package = jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(package.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(model.trees[:rounds], model.treeWeights[:rounds], strict=True)):
        trees[i], weights[i] = tree._java_obj, weight
    return GBTRegressionModel(package.GBTRegressionModel(f"{model.uid}_{rounds}", trees, weights))


def with_vector(rows: DataFrame, width: int) -> DataFrame:
    """Add ``features``, the sparse feature arrays as one vector."""
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = _dense(batch.column("indices"), batch.column("values"), width + 1)[:, 1:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, width, dtype=np.int32)), pa.array(dense.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "__dense"])

    schema = StructType([*rows.schema.fields, StructField("__dense", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema).withColumn("features", array_to_vector("__dense")).drop("__dense")


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows in partitions of some ``FIT_ROWS`` queries, where ``n`` rows in all are more than that."""
    return rows.repartition(-(-n // FIT_ROWS), "query_id") if n > FIT_ROWS else rows


def boosted_inputs(vectors: DataFrame, width: int, alphas: Sequence[float], members: Sequence[int],
                   params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Training and validation queries, one row each: features, the targets ``y`` of (alpha, candidate) in order, and
    the members' weights ``w``. A fit picks its target and weight by position, so no row is held once per fit."""
    places = [next(i for i, a in enumerate(params.alphas) if abs(a - alpha) <= 1e-9) for alpha in alphas]
    targets = F.array(*[F.get(item(i, "utilities"), F.lit(a)) for a in places for i in range(params.k)])
    n = row_bound(vectors)
    n = vectors.count() if n is None else n

    def of(split: str) -> DataFrame:
        return in_blocks(vectors.filter(F.col("split") == split).select("query_id", "indices", "values", targets.alias("y")), n)

    # Joined by id, as the weights belong to ids: a query that comes twice counts as in weighted_training.
    ids = vectors.filter(F.col("split") == "train").select("query_id")
    train = of("train").join(draw_weight_array(ids, str(params.seed), max(members) + 1, "w"), "query_id")
    return (with_vector(train, width).select("query_id", "features", "y", "w"),
            with_vector(of("validation"), width).select("query_id", "features", "y"))


def fit_boosted(vectors: DataFrame, width: int, path: str, alphas: Sequence[float], members: Sequence[int],
                params: Params = DEFAULT) -> DataFrame:
    """Boosted trees per (alpha, member, candidate) on the feature vectors, stored below ``path``; one report row per fit.

    A fit ends when ``params.boost_patience`` rounds, or ``params.boost_rounds`` in all, did not improve on validation,
    and is cut to its best round. All fits grow side by side; training rows carry the member's bootstrap weight.
    """
    train, valid = boosted_inputs(vectors, width, alphas, members, params)
    tasks = [(a, alpha, member, i, model) for a, alpha in enumerate(alphas) for member in members for i, model in enumerate(params.candidates)]
    fits = [boosting.Fit(a * params.k + i, member, draw_seed(params.seed, member, model)) for a, _, member, i, model in tasks]
    done = boosting.fit_all(train, valid, width, fits, params)
    rows = [(alpha, member, model, t, *(x[t] for x in fit[:3])) for (_, alpha, member, _, model), fit in zip(tasks, done, strict=True)
            for t in range(len(fit.feature))]
    stored = pa.table([pa.array(list(column), f.type) for column, f in zip(zip(*rows, strict=True), TREES_ARROW, strict=True)], schema=TREES_ARROW)
    spark = vectors.sparkSession
    keys = ["alpha", "member", "model"]
    spark.createDataFrame(stored).repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return spark.createDataFrame(
        [(alpha, member, model, len(fit.feature), float(fit.error) ** 0.5) for (_, alpha, member, _, model), fit in zip(tasks, done, strict=True)],
        "alpha double, member int, model string, iterations int, rmse double")


def stored_trees(spark: SparkSession, path: str, alphas: Sequence[float], members: Sequence[int],
                 params: Params = DEFAULT) -> dict[tuple[float, int, str], boosting.Fitted]:
    """The stored trees of each fit: rounds x 2^depth numbers a fit at any number of queries. A missing one is an error."""
    wanted = [(alpha, member, model) for alpha in alphas for member in members for model in params.candidates]
    table = spark.read.schema(TREES).parquet(path).filter(F.col("member").isin([int(m) for m in members])).orderBy("turn").toArrow()
    found: dict[tuple[float, int, str], list[int]] = {key: [] for key in wanted}
    for at, key in enumerate(zip(*[table.column(c).to_pylist() for c in ("alpha", "member", "model")], strict=True)):
        if key in found:
            found[key].append(at)
    if lacking := [model_path(path, *key) for key, at in found.items() if not at]:
        raise ValueError(f"{len(lacking)} models are not stored, as {lacking[0]}")
    columns = [_matrix(table.column(c).combine_chunks()) for c in ("feature", "threshold", "value")]
    return {key: boosting.Fitted(columns[0][at].astype(np.int64), columns[1][at], columns[2][at], 0.0) for key, at in found.items()}


def predict_boosted(queries: DataFrame, width: int, path: str, alphas: Sequence[float],
                    members: Sequence[int], params: Params = DEFAULT) -> DataFrame:
    """Predicted utility per (query, alpha, member) from stored models; a missing model is an error.

    The trees travel with the tasks; a row's features meet those of all models in one narrow pass.
    """
    models = queries.sparkSession.sparkContext.broadcast(list(stored_trees(queries.sparkSession, path, alphas, members, params).values()))
    fits, k = len(alphas) * len(members), params.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                x = _dense(batch.column("indices"), batch.column("values"), width + 1)[:, 1:]
                found = np.column_stack([boosting.scored(x, model) for model in models.value])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, k, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(fits, dtype=np.int32), batch.num_rows)),
                    batch.column("query_id").take(pa.array(np.repeat(np.arange(batch.num_rows), fits))), lists], ["fit", "query_id", "p"])

    rows = queries.select("query_id", "indices", "values").mapInArrow(run, "fit int, query_id string, p array<double>")
    named = F.array(*[F.struct(F.lit(params.alphas.index(alpha)).alias("alpha_id"), F.lit(alpha).alias("alpha"), F.lit(member).alias("member"))
                      for alpha in alphas for member in members])
    return rows.withColumn("of", F.get(named, F.col("fit"))).select(
        "query_id", "of.alpha_id", "of.alpha", "of.member", F.array(*[settled_double(F.col("p")[i]) for i in range(k)]).alias("yhat"))


def ridge_report(state: DataFrame) -> DataFrame:
    """Mean prediction, risk and error per (alpha, model) of a routing state."""
    long = state.select("alpha", "disagreement", F.inline("state"))
    error = F.col("mean") - F.col("actual")
    return long.groupBy("alpha", "model").agg(
        F.count(F.lit(1)).alias("n_queries"), mean_of("mean", 6).alias("mean_prediction"),
        mean_of("risk", 6).alias("mean_risk"), rounded(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        mean_of("disagreement", 6).alias("mean_disagreement"))
