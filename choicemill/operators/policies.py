"""Policy evaluation and the baselines that need no predictor.

A policy is a choice of one candidate per (query, alpha). The candidates' realised outcomes sit in
the query's own row, so evaluating a choice needs no join with the outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.candidates import argmax, item
from choicemill.functions.numeric import count_true, mean_of, rounded
from choicemill.operators.order import attach, settled
from choicemill.params import DEFAULT, Params


def by_alpha(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per (query, alpha); ``alpha_id`` is the position in the grid."""
    grid = F.array(*[F.struct(F.lit(i).alias("alpha_id"), F.lit(a).alias("alpha"))
                     for i, a in enumerate(params.alphas)])
    return core.select("*", F.inline(grid))


def realised(i: int) -> Column:
    return F.get(item(i, "utilities"), F.col("alpha_id"))


def oracle(params: Params = DEFAULT) -> Column:
    """Best realised candidate of the query: struct(score = utility, model)."""
    return argmax(params.k, realised, lambda i: {"model": item(i, "model")})


def outcome(i: int) -> dict[str, Column]:
    return {"model": item(i, "model"), "ord": F.lit(i), "correct": item(i, "correct"),
            "cost": item(i, "cost_clean"), "latency": item(i, "latency"), "utility": realised(i)}


def outcome_struct(i: int) -> Column:
    return F.struct(*[value.alias(name) for name, value in outcome(i).items()])


def chosen(ordinal: Column, params: Params = DEFAULT) -> Column:
    """Outcome struct of the candidate with the given position."""
    return F.get(F.array(*[outcome_struct(i) for i in range(params.k)]), ordinal)


def fixed_choices(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every candidate as a policy of its own: (query, alpha, chosen, best)."""
    rows = by_alpha(core, params).withColumn("best", oracle(params))
    every = F.array(*[outcome_struct(i) for i in range(params.k)])
    return rows.select("query_id", "category", "dataset", "alpha", "best", F.explode(every).alias("pick"))


def policy_metrics(params: Params = DEFAULT, counts: bool = True) -> list[Column]:
    """Aggregates over rows with ``pick`` (outcome struct) and ``best`` (oracle struct)."""
    metrics = [
        F.count(F.lit(1)).alias("n_queries"),
        mean_of("pick.correct").alias("accuracy"),
        mean_of("pick.cost").alias("avg_cost"),
        mean_of("pick.latency").alias("avg_latency"),
        mean_of("pick.utility").alias("mean_utility"),
        mean_of("best.score").alias("oracle_utility"),
        mean_of(F.col("best.score") - F.col("pick.utility")).alias("mean_regret"),
    ]
    if counts:
        metrics += [count_true(F.col("pick.model") == c).alias(f"selected_{c}") for c in params.candidates]
    return metrics


def fixed_policies(core: DataFrame, split: str = "test", params: Params = DEFAULT) -> DataFrame:
    """Each candidate chosen for every query, per alpha; one pass, one small aggregate."""
    rows = fixed_choices(core.filter(F.col("split") == split), params)
    return (rows.groupBy("alpha", F.concat(F.lit("Fixed "), "pick.model").alias("policy"))
            .agg(*policy_metrics(params)))


def oracle_decisions(core: DataFrame, split: str = "test", params: Params = DEFAULT) -> DataFrame:
    """Best candidate per (query, alpha) with its utility, and the regret of each candidate."""
    rows = by_alpha(core.filter(F.col("split") == split), params).withColumn("best", oracle(params))
    regrets = [rounded(F.col("best.score") - realised(i), 6).alias(f"regret_{c}")
               for i, c in enumerate(params.candidates)]
    return rows.select("query_id", "alpha", F.col("best.model").alias("oracle_model"),
                       F.col("best.score").alias("oracle_utility"), *regrets)


def mean_utilities(core: DataFrame, split: str, keys: list[str], params: Params = DEFAULT) -> DataFrame:
    """Mean realised utility per (alpha, keys) as an array over candidates.

    Means are settled at 12 decimals, so equal means tie whatever the order of summation.
    """
    rows = by_alpha(core.filter(F.col("split") == split), params)
    means = rows.groupBy("alpha", *keys).agg(*[
        F.avg(realised(i)).cast("decimal(38,12)").cast("double").alias(f"__u{i}") for i in range(params.k)])
    return means.select("alpha", *keys, F.array(*[f"__u{i}" for i in range(params.k)]).alias("means"))


def best_mean(params: Params, alphabetical: bool = False) -> Column:
    """Struct(score, model, ord) of the highest mean; ties by candidate order or by name."""
    names = sorted(params.candidates)
    tie: Callable[[int], int] = (lambda i: names.index(params.candidates[i])) if alphabetical else (lambda i: i)
    return F.greatest(*[
        F.struct(F.col("means")[i].alias("score"), F.lit(-tie(i)).alias("neg_tie"),
                 F.lit(c).alias("model"), F.lit(i).alias("ord"))
        for i, c in enumerate(params.candidates)])


def best_fixed_selection(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per alpha, the candidate with the highest mean utility on validation, and all the means."""
    best = mean_utilities(core, "validation", [], params).withColumn("b", best_mean(params))
    return best.select(
        "alpha", F.col("b.model").alias("selected_model"), F.col("b.ord").alias("selected_ord"),
        rounded("b.score", 8).alias("validation_mean_utility"),
        *[rounded(F.col("means")[i], 8).alias(f"validation_utility_{c}")
          for i, c in enumerate(params.candidates)])


def best_fixed_policy(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The frozen validation choice, scored on test. Its table has one row per alpha."""
    selection = F.broadcast(best_fixed_selection(core, params).select(
        "alpha", "selected_ord", F.col("selected_model").alias("validation_selected_model"),
        "validation_mean_utility"))
    rows = by_alpha(core.filter(F.col("split") == "test"), params).join(selection, "alpha")
    rows = rows.withColumn("best", oracle(params)).withColumn("pick", chosen(F.col("selected_ord"), params))
    return (rows.groupBy("alpha", "validation_selected_model", "validation_mean_utility")
            .agg(*policy_metrics(params)).withColumn("policy", F.lit("Best Fixed Utility")))


def category_map(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Best candidate per (alpha, category) on training data, with the global fallback."""
    best = mean_utilities(core, "train", ["category"], params).withColumn("b", best_mean(params, True))
    fallback = mean_utilities(core, "train", [], params).withColumn("f", best_mean(params))
    fallback = F.broadcast(fallback.select("alpha", F.col("f.model").alias("fallback_model")))
    return best.join(fallback, "alpha").select(
        "alpha", "category", F.col("b.model").alias("selected_model"), F.col("b.ord").alias("selected_ord"),
        rounded("b.score", 8).alias("training_mean_utility"), "fallback_model")


def fallback_choice(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per alpha, the best candidate over all training queries."""
    best = mean_utilities(core, "train", [], params).withColumn("f", best_mean(params))
    return best.select("alpha", F.col("f.model").alias("fallback_model"), F.col("f.ord").alias("fallback_ord"),
                       rounded("f.score", 8).alias("training_mean_utility"))


def category_choices(core: DataFrame, mapping: DataFrame, fallback: DataFrame, split: str,
                     params: Params = DEFAULT) -> DataFrame:
    """Apply a frozen category map; categories it does not know get the fallback.

    The map is nested per category first, so the join happens before the queries are multiplied by
    alpha. It is broadcast only when its checked size allows.
    """
    per_category = mapping.groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("alpha", "selected_ord"))).alias("__map"))
    rows = attach(core.filter(F.col("split") == split), settled(per_category), ["category"], "query_id", "left",
                  params)
    rows = by_alpha(rows, params).join(F.broadcast(fallback.select("alpha", "fallback_ord")), "alpha")
    ordinal = F.coalesce(F.try_element_at("__map", F.col("alpha")), F.col("fallback_ord"))
    return rows.withColumn("best", oracle(params)).withColumn("pick", chosen(ordinal, params))


def category_policy(core: DataFrame, mapping: DataFrame, fallback: DataFrame, split: str,
                    params: Params = DEFAULT) -> DataFrame:
    rows = category_choices(core, mapping, fallback, split, params)
    return rows.groupBy("alpha").agg(*policy_metrics(params)).withColumn(
        "policy", F.lit("Category Router (train-selected)"))


