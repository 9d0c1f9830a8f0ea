"""Fitted ensembles, routing states and frozen penalties of the sourcing chain, as written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemill.operators import ensemble, quality, routing
from choicemill.params import Params
from choicemill.plans.sourcing import FIXTURE, stage_core
from choicemill.sources.stages import row_bound, with_row_bound, written

FULL, ABLATION = "category", "dataset"


def stage_model(spark: SparkSession, sf_dir: str, group: str = FULL, bootstrap: bool = True,
                params: Params = FIXTURE) -> DataFrame:
    return written(spark, f"model|{group}|{bootstrap}|{sf_dir}|{params}",
                   lambda: ensemble.fit_group_means(stage_core(spark, sf_dir, params), group, params, bootstrap))


def member_predictions(spark: SparkSession, sf_dir: str, group: str = FULL, bootstrap: bool = True,
                       params: Params = FIXTURE) -> DataFrame:
    """Predictions of every member for every group among the queries; all members must be stored."""
    model = stage_model(spark, sf_dir, group, bootstrap, params)
    if bootstrap:
        quality.require_none(ensemble.missing_members(model, params), "stored ensemble lacks a member")
    groups = stage_core(spark, sf_dir, params).select(F.col(group).alias("grp")).distinct()
    return ensemble.predict_groups(model, groups, params.members if bootstrap else 1, params)


def stage_stats(spark: SparkSession, sf_dir: str, group: str = FULL, bootstrap: bool = True,
                params: Params = FIXTURE) -> DataFrame:
    """Ensemble statistics per (group, alpha)."""
    return written(spark, f"stats|{group}|{bootstrap}|{sf_dir}|{params}", lambda: ensemble.ensemble_stats(
        member_predictions(spark, sf_dir, group, bootstrap, params), ["grp"],
        params.members if bootstrap else 1, params))


def stage_state(spark: SparkSession, sf_dir: str, group: str = FULL, bootstrap: bool = True,
                params: Params = FIXTURE) -> DataFrame:
    """Routing state of validation and test queries."""

    def build() -> DataFrame:
        stats = stage_stats(spark, sf_dir, group, bootstrap, params)
        queries = stage_core(spark, sf_dir, params).filter(F.col("split") != "train")
        return ensemble.routing_state(queries, stats, {"grp": group}, params)

    return written(spark, f"state|{group}|{bootstrap}|{sf_dir}|{params}", build, ["split"])


def state(spark: SparkSession, sf_dir: str, split: str, group: str = FULL, bootstrap: bool = True,
          params: Params = FIXTURE) -> DataFrame:
    whole = stage_state(spark, sf_dir, group, bootstrap, params)
    return with_row_bound(whole.filter(F.col("split") == split), row_bound(whole))


def stage_lambdas(spark: SparkSession, sf_dir: str, group: str = FULL, params: Params = FIXTURE) -> DataFrame:
    """Frozen penalties: written before any test query is read."""
    return written(spark, f"lambdas|{group}|{sf_dir}|{params}", lambda: routing.best_lambdas(
        routing.lambda_sweep(state(spark, sf_dir, "validation", group, True, params), params)))


def stage_decisions(spark: SparkSession, sf_dir: str, group: str = FULL, params: Params = FIXTURE) -> DataFrame:
    """Test decisions of both routers."""
    return written(spark, f"decisions|{group}|{sf_dir}|{params}", lambda: routing.decisions(
        routing.two_routers(state(spark, sf_dir, "test", group, True, params),
                            stage_lambdas(spark, sf_dir, group, params)), params))


def both_selections(spark: SparkSession, sf_dir: str, group: str = FULL, params: Params = FIXTURE) -> DataFrame:
    return routing.both_selections(state(spark, sf_dir, "test", group, True, params),
                                   stage_lambdas(spark, sf_dir, group, params), params)
