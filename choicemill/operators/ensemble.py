"""Bootstrap ensembles of utility predictors, and statistics over their members.

Resampling is a Poisson(1) weight per (member, query), drawn from a hash: every candidate of a
member sees the same resample by construction, and no index arrays exist. Utility is linear in
alpha, so a linear learner is fitted once for the outcome and once for the cost and serves every
alpha.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.candidates import argmax, item
from choicemill.functions.hashing import with_draw_weights
from choicemill.functions.numeric import count_true, mean_of, rounded, settled_double
from choicemill.operators.order import attach, null_safe_join
from choicemill.operators.policies import by_alpha, oracle, realised
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import row_bound, with_row_bound


# ---------------------------------------------------------------- group means

def weighted_training(core: DataFrame, params: Params = DEFAULT, bootstrap: bool = True) -> DataFrame:
    """Training queries, once per member that drew them, with their weight ``w``.

    Without bootstrap there is one member, 0, that holds every query once.
    """
    train = core.filter(F.col("split") == "train")
    if not bootstrap:
        return train.withColumn("member", F.lit(0)).withColumn("w", F.lit(1))
    return with_draw_weights(train, str(params.seed), params.members, "member")


def fit_group_means(core: DataFrame, group: str, params: Params = DEFAULT, bootstrap: bool = True) -> DataFrame:
    """Weighted sums per (member, group): weight, outcomes and costs of each candidate.

    One aggregate for all members, candidates and alphas. Rows collapse before the shuffle, so a
    group with a third of all queries costs no more than a small one.
    """
    # Only 2K numbers per query are multiplied by the members.
    fields = [c for i in range(params.k) for c in (
        item(i, "correct").alias(f"c{i}"), item(i, "normalized_cost").alias(f"n{i}"))]
    narrow = core.select("query_id", "split", F.col(group).alias("grp"), *fields)
    rows = weighted_training(narrow, params, bootstrap)
    w = F.col("w")
    sums = [F.sum(w).alias("w")]
    for i in range(params.k):
        sums += [F.sum(w * F.col(f"c{i}")).cast("double").alias(f"c{i}"), F.sum(w * F.col(f"n{i}")).alias(f"n{i}")]
    return rows.groupBy("member", "grp").agg(*sums)


def _means(params: Params, prefix: str) -> list[Column]:
    return [F.array(*[F.col(f"{kind}{i}") / F.col("w") for i in range(params.k)]).alias(f"{prefix}{name}")
            for kind, name in (("c", "correct"), ("n", "cost"))]


def missing_members(model: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Members of the ensemble that a stored model lacks."""
    members = model.sparkSession.range(params.members).select(F.col("id").cast("int").alias("member"))
    return members.join(model.select("member").distinct(), "member", "left_anti")


def predict_groups(model: DataFrame, groups: DataFrame, members: int, params: Params = DEFAULT) -> DataFrame:
    """Predicted utility per (grp, alpha, member) as an array over candidates.

    Prediction depends on the group only, so it runs on groups and not on queries. A group a
    member never drew gets the member's mean over all groups.
    """
    overall = model.groupBy("member").agg(*[F.sum(c).alias(c) for c in model.columns
                                            if c not in ("member", "grp")])
    overall = F.broadcast(overall.select("member", *_means(params, "all_")))  # one row per member
    fitted = model.select("member", "grp", *_means(params, ""))
    every = groups.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    joined = null_safe_join(every, fitted, ["grp", "member"], "left").join(overall, "member")
    grid = F.array(*[F.struct(F.lit(i).alias("alpha_id"), F.lit(a).alias("alpha"))
                     for i, a in enumerate(params.alphas)])
    correct, cost = F.coalesce("correct", "all_correct"), F.coalesce("cost", "all_cost")
    rows = joined.select("grp", "member", correct.alias("correct"), cost.alias("cost"), F.inline(grid))
    yhat = F.array(*[settled_double(F.col("correct")[i] - F.col("alpha") * F.col("cost")[i])
                     for i in range(params.k)])
    return rows.select("grp", "alpha_id", "alpha", "member", yhat.alias("yhat"))


# ---------------------------------------------------------------- member statistics

def member_choice(params: Params = DEFAULT) -> Column:
    """Position of the member's favourite candidate."""
    return -argmax(params.k, lambda i: F.col("yhat")[i], lambda i: {})["neg_ord"]


def ensemble_stats(predictions: DataFrame, keys: Sequence[str], members: int,
                   params: Params = DEFAULT) -> DataFrame:
    """Mean, risk, vote fractions, disagreement and vote entropy per (keys, alpha).

    ``predictions`` has one row per (keys, alpha, member). Risk is the population standard
    deviation over members. Means and risks are rounded to eight decimals here, once, and used so
    by every later step.
    """
    rows = predictions.withColumn("pick", member_choice(params))
    grouped = rows.groupBy(*keys, "alpha_id", "alpha").agg(
        *[mean_of(F.col("yhat")[i], 8).alias(f"__m{i}") for i in range(params.k)],
        *[rounded(F.stddev_pop(F.col("yhat")[i]), 8).alias(f"__s{i}") for i in range(params.k)],
        *[count_true(F.col("pick") == i).alias(f"__v{i}") for i in range(params.k)])

    def array(prefix: str) -> Column:
        return F.array(*[F.col(f"__{prefix}{i}") for i in range(params.k)])

    fractions = [F.col(f"__v{i}") / F.lit(float(members)) for i in range(params.k)]
    return grouped.select(
        *keys, "alpha_id", "alpha", array("m").alias("means"), array("s").alias("risks"),
        F.array(*[rounded(p, 8) for p in fractions]).alias("votes"),
        rounded(F.lit(1.0) - F.greatest(*fractions), 8).alias("disagreement"),
        entropy_of(fractions, params).alias("entropy"))


def routing_state(core: DataFrame, stats: DataFrame, keys: dict[str, str], params: Params = DEFAULT) -> DataFrame:
    """One row per (query, alpha): candidates with prediction, risk and realised outcome.

    ``keys`` maps the key columns of ``stats`` to columns of the queries. The statistics of groups
    are broadcast when their checked size allows; else the join is salted. Pass
    a written table, so that checking its size is cheap.
    """
    named = stats.select(*[F.col(k).alias(f"__{k}") for k in keys], "alpha_id", "means", "risks", "votes",
                         "disagreement", "entropy")
    named = with_row_bound(named, row_bound(stats))
    rows = by_alpha(core, params)
    for key, column in keys.items():
        rows = rows.withColumn(f"__{key}", F.col(column))
    return _with_states(attach(rows, named, [*[f"__{k}" for k in keys], "alpha_id"], "query_id", "inner", params), params)


def _with_states(joined: DataFrame, params: Params) -> DataFrame:
    """Routing state of rows per (query, alpha) with means, risks, votes, disagreement and entropy."""
    states = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("ord"), F.col("means")[i].alias("mean"),
                 F.col("risks")[i].alias("risk"), realised(i).alias("actual"),
                 item(i, "correct").alias("correct"), item(i, "cost_clean").alias("cost"),
                 item(i, "raw_cost").alias("raw_cost"), item(i, "latency").alias("latency"))
        for i, m in enumerate(params.candidates)])
    best = oracle(params)
    return joined.select("query_id", "dataset", "category", "split", "alpha_id", "alpha", states.alias("state"),
                         "votes", "disagreement", "entropy", best["model"].alias("oracle_model"),
                         best["score"].alias("oracle_utility"))


def entropy_of(fractions: Sequence[Column], params: Params) -> Column:
    """Entropy of vote fractions over that of an even vote; zeros are skipped."""
    entropy = None
    for p in fractions:
        term = F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))
        entropy = term if entropy is None else entropy + term
    return rounded(entropy / F.lit(math.log(params.k)), 8)


def state_from_predictions(core: DataFrame, predictions: str, members: int, params: Params = DEFAULT) -> DataFrame:
    """Routing state of queries that carry their members' predictions; nothing is shuffled.

    ``predictions`` names an array over members of structs (correct, cost), arrays over candidates each.
    Mean, risk and votes over the members are taken inside the row, by the same rules as in ``ensemble_stats``.
    """
    rows = by_alpha(core, params)

    def utility(m: Column, i: int) -> Column:
        return settled_double(m["correct"][i] - F.col("alpha") * m["cost"][i])

    yhat = F.transform(predictions, lambda m: F.array(*[utility(m, i) for i in range(params.k)]))
    rows = rows.withColumn("__yhat", yhat)

    def of(i: int) -> Column:
        return F.transform("__yhat", lambda y: y[i])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    n = F.lit(float(members))
    rows = rows.select("*", *[(total(of(i)) / n).alias(f"__mean{i}") for i in range(params.k)])

    def deviation(i: int) -> Column:
        mean = F.col(f"__mean{i}")
        return F.sqrt(total(F.transform(of(i), lambda v: (v - mean) * (v - mean))) / n)

    def votes_for(i: int) -> Column:
        return F.size(F.filter("__picks", lambda p: p == i + 1)) / n

    risks = [deviation(i) for i in range(params.k)]
    # The first candidate wins a tie: the place of a member's highest prediction.
    picks = F.transform("__yhat", lambda y: F.array_position(y, F.array_max(y)))
    rows = rows.withColumn("__picks", picks)
    rows = rows.select("*", *[votes_for(i).alias(f"__vote{i}") for i in range(params.k)])
    votes = [F.col(f"__vote{i}") for i in range(params.k)]
    return _with_states(rows.select(
        *core.columns, "alpha_id", "alpha", F.array(*[rounded(F.col(f"__mean{i}"), 8) for i in range(params.k)]).alias("means"),
        F.array(*[rounded(r, 8) for r in risks]).alias("risks"), F.array(*[rounded(v, 8) for v in votes]).alias("votes"),
        rounded(F.lit(1.0) - F.greatest(*votes), 8).alias("disagreement"), entropy_of(votes, params).alias("entropy")), params)


def predictor_errors(state: DataFrame) -> DataFrame:
    """MAE and RMSE of the mean prediction per (alpha, model)."""
    long = state.select("alpha", F.inline("state"))
    error = F.col("mean") - F.col("actual")
    return long.groupBy("alpha", "model").agg(
        F.count(F.lit(1)).alias("n_queries"), mean_of(F.abs(error)).alias("mae"),
        rounded(F.sqrt(F.avg(error * error))).alias("rmse"))


def training_pairs(core: DataFrame, feature_columns: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    """Training rows per (query, model, alpha): features and target; candidates sit in the query's
    row, so there is no join."""
    rows = by_alpha(core.filter(F.col("split") == "train"), params)
    targets = F.array(*[F.struct(F.lit(m).alias("model"), realised(i).alias("target"))
                        for i, m in enumerate(params.candidates)])
    return rows.select("query_id", "alpha", *feature_columns, F.inline(targets))
