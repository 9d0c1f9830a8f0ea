"""The linear learner over the feature table of the sourcing chain: vectors, moments, states, ablation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemill.functions.candidates import item
from choicemill.functions.numeric import rounded
from choicemill.operators import ensemble, features, learners, routing
from choicemill.operators.features import Family
from choicemill.operators.quality import require_none, side_mismatches
from choicemill.params import Params
from choicemill.plans.sourcing import FIXTURE, NUMERIC_FEATURES, stage_core, with_question
from choicemill.sources.stages import written
from choicemill.sources.tables import table

STRUCTURE = ("char_count", "word_count", "approx_token_count", "line_count", "sentence_count", "number_count", "math_symbol_count",
             "question_mark_count", "option_count", "is_multiple_choice", "avg_word_length")
_families: dict[tuple[str, str], list[Family]] = {}
_checked: set[tuple[str, str]] = set()


def _once(spark: SparkSession, key: str, check: Callable[[], object]) -> None:
    """Run a check of a written stage once per application; one that failed is run again, and fails again."""
    memo = (spark.sparkContext.applicationId, key)
    if memo not in _checked:
        check()
        _checked.add(memo)


def stage_vectors(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> tuple[DataFrame, list[Family]]:
    """Conditioned queries with their sparse feature vector, and the manifest: one shuffle by the embedding's id."""
    memo = (spark.sparkContext.applicationId, f"vectors|{sf_dir}|{params}")

    def build() -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings")
        n = vectors.count()
        dimensions = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        rows = with_question(stage_core(spark, sf_dir, params), spark, sf_dir)
        rows = features.text_features(rows).drop("question").withColumn("__vec", F.col("p_partkey") % n)
        rows = features.with_embedding(rows, vectors, "__vec").drop("__vec")
        made, _families[memo] = features.feature_vectors(
            rows, {"numeric": NUMERIC_FEATURES, "structure": STRUCTURE}, ["dataset", "category"], "embedding",
            dimensions, params)
        return made.drop(*STRUCTURE, "embedding")

    whole = written(spark, memo[1], build, ["split"])
    _once(spark, memo[1], lambda: features.require_finite(whole))
    return whole, _families[memo]


def family_of(families: list[Family], position: Column) -> Column:
    """Name of the family that holds a position of the vector."""
    name = None
    for f in families:
        here = (position >= f.start) & (position < f.stop)
        name = F.when(here, f.name) if name is None else name.when(here, f.name)
    return name


def width(families: list[Family]) -> int:
    return families[-1].stop


def stage_moments(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    vectors, families = stage_vectors(spark, sf_dir, params)
    key = f"moments|{sf_dir}|{params}"
    _once(spark, key, lambda: require_none(
        side_mismatches(vectors, stage_core(spark, sf_dir, params), "cands", params), "features and outcomes differ"))
    return written(spark, key, lambda: learners.moment_blocks(vectors, width(families), params))


def coefficients(spark: SparkSession, sf_dir: str, without: str = "", params: Params = FIXTURE) -> dict:
    """Coefficients of all members, without the named family of features."""
    _, families = stage_vectors(spark, sf_dir, params)
    ranges = [(f.start, f.stop) for f in families if f.name == without]
    if without and not ranges:
        raise ValueError(f"no feature family {without}")
    return learners.ridge_coefficients(learners.read_blocks(stage_moments(spark, sf_dir, params)), width(families),
                                       without=ranges, params=params)


def stage_ridge_state(spark: SparkSession, sf_dir: str, without: str = "", params: Params = FIXTURE) -> DataFrame:
    """Routing state of validation and test queries; members' statistics are taken in the query's own row."""

    def build() -> DataFrame:
        vectors, _ = stage_vectors(spark, sf_dir, params)
        fitted = coefficients(spark, sf_dir, without, params)
        members = {m: c for m, c in fitted.items() if m != learners.PLAIN}
        rows = learners.with_predictions(vectors.filter(F.col("split") != "train"), members, "predictions", params)
        return ensemble.state_from_predictions(rows, "predictions", params.members, params)

    return written(spark, f"ridge_state|{without}|{sf_dir}|{params}", build, ["split"])


def ablation_errors(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    """Validation errors of the plain fit without each family of features in turn, and with all: one pass over the rows."""
    vectors, families = stage_vectors(spark, sf_dir, params)
    dropped = ["", *[f.name for f in families]]
    fits = {i: coefficients(spark, sf_dir, name, params)[learners.PLAIN] for i, name in enumerate(dropped)}
    rows = learners.with_predictions(vectors.filter("split = 'validation'"), fits, "fits", params)
    names = F.array(*[F.lit(name or "none") for name in dropped])
    each = rows.select("cands", F.posexplode("fits").alias("fit", "p"))
    long = each.select(F.get(names, "fit").alias("dropped"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col("p.correct")[i] - item(i, "correct")).alias("correct_error"),
                 (F.col("p.cost")[i] - item(i, "normalized_cost")).alias("cost_error")) for i, m in enumerate(params.candidates)])))
    return long.groupBy("dropped", "model").agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[rounded(F.sqrt(F.avg(F.col(f"{c}_error") * F.col(f"{c}_error"))), 6).alias(f"{c}_rmse") for c in ("correct", "cost")])


def ridge_test_summary(spark: SparkSession, sf_dir: str, without: str = "", params: Params = FIXTURE) -> DataFrame:
    """Penalty chosen on validation, both routers scored on test."""
    state = stage_ridge_state(spark, sf_dir, without, params)
    chosen = written(spark, f"ridge_lambdas|{without}|{sf_dir}|{params}", lambda: routing.best_lambdas(
        routing.lambda_sweep(state.filter("split = 'validation'"), params)))
    decided = routing.decisions(routing.two_routers(state.filter("split = 'test'"), chosen), params)
    return routing.summarise(decided, ["alpha", "lambda", "router"])
