"""Prediction errors and ranking errors of the ensemble mean."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.candidates import argmax
from choicemill.functions.numeric import count_true, mean_of, mean_where, ratio, rounded
from choicemill.operators.order import exact_quantiles, null_safe_join
from choicemill.operators.routing import field
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import fits, row_bound, with_row_bound


def error_table(state: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Long (query, alpha, model): prediction, risk, realised outcome and errors."""
    long = state.select("query_id", "dataset", "category", "alpha", F.inline("state"))
    error = F.col("mean") - F.col("actual")
    bound = row_bound(state)
    return with_row_bound(long.select(
        "query_id", "dataset", "category", "alpha", "model", F.col("mean").alias("predicted_utility"),
        F.col("risk").alias("predictive_risk"), F.col("actual").alias("realised_utility"), "correct",
        "raw_cost", F.col("cost").alias("cost_clean"), rounded(error).alias("prediction_error"),
        rounded(F.abs(error)).alias("abs_prediction_error"), rounded(error * error).alias("squared_prediction_error")),
        None if bound is None else bound * params.k)


def error_summary(errors: DataFrame, keys: Sequence[str], params: Params = DEFAULT,
                  spread: bool | None = None) -> DataFrame:
    """n, MAE, median and P90 absolute error, RMSE, bias and mean risk per key; NULL keys kept."""
    e, a = F.col("prediction_error"), F.col("abs_prediction_error")
    if spread is None:
        spread = not fits(errors, params.small_rows)
    basic = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mean_of(a).alias("mae"), rounded(F.sqrt(F.avg(e * e))).alias("rmse"),
        mean_of(e).alias("mean_signed_error"), mean_of("predictive_risk").alias("mean_risk"))
    quantiles = exact_quantiles(errors, keys, "abs_prediction_error", [0.5, 0.9], params, spread)
    quantiles = quantiles.select(*keys, rounded(F.col("q")[0]).alias("median_abs_error"),
                                 rounded(F.col("q")[1]).alias("p90_abs_error"))
    return null_safe_join(basic, quantiles, keys)


def pair_terms(a: int, b: int) -> tuple[Column, Column, Column, Column]:
    """Predicted and realised gaps of two candidates, whether both are strict, whether they disagree.

    Gaps of 6-decimal utilities are rounded back, so equal realised values are exact ties.
    """
    predicted = F.round(field(a, "mean") - field(b, "mean"), 8)
    realised = F.round(field(a, "actual") - field(b, "actual"), 6)
    strict = (predicted != 0) & (realised != 0)
    return predicted, realised, strict, strict & (F.signum(predicted) != F.signum(realised))


def ranking_rows(state: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per (query, alpha): top choice, margin, match, regret and pairwise inversions.

    All of it reads the candidates in the query's own row; a query without a full candidate set
    is left out.
    """
    k = params.k
    full = None
    for i in range(k):
        present = field(i, "mean").isNotNull() & field(i, "actual").isNotNull()
        full = present if full is None else full & present
    order = F.array_sort(F.array(*[F.struct((-field(i, "mean")).alias("s"), F.lit(i).alias("o")) for i in range(k)]))
    best = argmax(k, lambda i: field(i, "actual"), lambda i: {"model": field(i, "model")})
    rows = state.filter(full).withColumn("__o", order).withColumn("__b", best)
    rows = rows.withColumn("__top", F.get("state", F.col("__o")[0]["o"])).withColumn(
        "__second", F.get("state", F.col("__o")[1]["o"]))
    inversions, valid, names = F.lit(0), F.lit(0), []
    for a, b in combinations(range(k), 2):
        _, _, strict, disagree = pair_terms(a, b)
        valid = valid + strict.cast("int")
        inversions = inversions + disagree.cast("int")
        names.append(F.when(disagree, F.lit(f"{params.candidates[a]}>{params.candidates[b]}")))
    errors = [F.abs(field(i, "mean") - field(i, "actual")) for i in range(k)]
    total = errors[0]
    for e in errors[1:]:
        total = total + e
    regret = F.round(F.col("__b.score") - F.col("__top.actual"), 6)
    error = F.col("__top.mean") - F.col("__top.actual")
    return with_row_bound(rows.select(
        "query_id", "alpha", "dataset", "category", F.col("__top.model").alias("predicted_top_model"),
        F.col("__b.model").alias("realised_top_model"),
        (F.col("__top.model") == F.col("__b.model")).cast("int").alias("top1_match"),
        F.col("__top.mean").alias("predicted_top_utility"), F.col("__second.mean").alias("predicted_second_utility"),
        F.round(F.col("__top.mean") - F.col("__second.mean"), 8).alias("predicted_margin"),
        rounded(error).alias("selected_prediction_error"), rounded(F.abs(error)).alias("selected_abs_error"),
        F.col("__top.risk").alias("selected_risk"), rounded(total / k).alias("mean_abs_error_all_models"),
        rounded(F.greatest(*errors)).alias("max_abs_error_all_models"), regret.alias("realised_regret"),
        (regret > params.material_regret).cast("int").alias("material_failure"),
        inversions.alias("pairwise_inversions"), valid.alias("valid_pairwise_comparisons"),
        ratio(inversions, valid).alias("pairwise_inversion_rate"), F.concat_ws(";", *names).alias("reversed_pairs")),
        row_bound(state))


def pairwise_reversals(state: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per (alpha, candidate pair): comparable queries, reversals and mean gaps.

    One aggregate per alpha with a few columns per pair; no self-join and no row per pair.
    """
    pairs = list(combinations(range(params.k), 2))
    aggregates = []
    for a, b in pairs:
        predicted, realised, strict, disagree = pair_terms(a, b)
        aggregates += [count_true(strict).alias(f"n_{a}_{b}"), count_true(disagree).alias(f"r_{a}_{b}"),
                       mean_where(F.abs(predicted), strict).alias(f"p_{a}_{b}"),
                       mean_where(F.abs(realised), strict).alias(f"g_{a}_{b}")]
    rows = [F.struct(
        F.lit(params.candidates[a]).alias("model_a"), F.lit(params.candidates[b]).alias("model_b"),
        F.col(f"n_{a}_{b}").alias("n_queries"), F.col(f"r_{a}_{b}").alias("n_reversals"),
        ratio(F.col(f"r_{a}_{b}"), F.col(f"n_{a}_{b}")).alias("reversal_rate"),
        F.col(f"p_{a}_{b}").alias("mean_predicted_gap"), F.col(f"g_{a}_{b}").alias("mean_realised_gap"))
        for a, b in pairs]
    return state.groupBy("alpha").agg(*aggregates).select("alpha", F.inline(F.array(*rows)))


def ranking_summary(rows: DataFrame) -> DataFrame:
    """Per alpha, overall and split by whether the top choice was right."""
    right, wrong = F.col("top1_match") == 1, F.col("top1_match") == 0
    split = []
    for name, column in (("margin", "predicted_margin"), ("abs_error", "selected_abs_error"),
                         ("risk", "selected_risk"), ("regret", "realised_regret")):
        split += [mean_where(F.col(column), right).alias(f"ranking_correct_mean_{name}"),
                  mean_where(F.col(column), wrong).alias(f"ranking_wrong_mean_{name}")]
    return rows.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n_queries"), mean_of("top1_match").alias("top1_match_rate"),
        rounded(1 - F.avg("top1_match")).alias("top1_ranking_error_rate"),
        mean_of("pairwise_inversion_rate").alias("mean_pairwise_inversion_rate"),
        mean_of("predicted_margin").alias("mean_predicted_margin"), *split,
        mean_of("material_failure").alias("material_failure_rate"))


def _ranking_metrics(margin: str, error: str, risk: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_queries"), mean_of("top1_match").alias("top1_match_rate"),
            mean_of("predicted_margin").alias(margin), mean_of("selected_abs_error").alias(error),
            mean_of("selected_risk").alias(risk), mean_of("realised_regret").alias("mean_regret"),
            mean_of("material_failure").alias("material_failure_rate"),
            mean_of("pairwise_inversion_rate").alias("mean_pairwise_inversion_rate")]


def ranking_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("alpha", "category").agg(
        *_ranking_metrics("mean_predicted_margin", "mean_selected_abs_error", "mean_selected_risk"))


def with_margin_bin(rows: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Add ``margin_bin`` 1..5: right-closed bins at interpolated quintiles per alpha.

    Equal edges merge, so ties never split and there may be fewer bins. Edges are one row per alpha.
    """
    if spread is None:
        spread = not fits(rows, params.small_rows)
    edges = exact_quantiles(rows, ["alpha"], "predicted_margin", [0.0, 0.2, 0.4, 0.6, 0.8], params, spread)
    edges = F.broadcast(edges)  # one row per alpha of the grid
    joined = null_safe_join(rows, edges, ["alpha"])
    passed, q = F.lit(1), F.col("q")
    for i in range(1, 5):
        passed = passed + ((q[i] < F.col("predicted_margin")) & (q[i] > q[i - 1])).cast("int")
    return joined.withColumn("margin_bin", passed).drop("q")


def ranking_by_margin(rows: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Metrics per (alpha, margin quintile)."""
    bins = with_margin_bin(rows, params, spread)
    label = (F.when(F.col("margin_bin") == 1, "Q1 smallest").when(F.col("margin_bin") == 5, "Q5 largest")
             .otherwise(F.concat(F.lit("Q"), F.col("margin_bin").cast("string"))))
    return bins.groupBy("alpha", label.alias("margin_quintile")).agg(
        *_ranking_metrics("mean_margin", "mean_abs_error", "mean_risk"))
