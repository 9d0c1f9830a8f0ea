"""What the risk penalty changed: mechanism, groups and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.candidates import ranking
from choicemill.functions.numeric import count_true, mean_of, ratio, rounded
from choicemill.operators.routing import field
from choicemill.params import DEFAULT, Params

# Correctness transitions of a changed decision.
TRANSITIONS = ("wrong_to_correct", "correct_to_wrong", "both_correct", "both_wrong")


def transition(before: Column, after: Column) -> Column:
    return (F.when((before == 0) & (after == 1), TRANSITIONS[0]).when((before == 1) & (after == 0), TRANSITIONS[1])
            .when((before == 1) & (after == 1), TRANSITIONS[2]).otherwise(TRANSITIONS[3]))


def changed_details(pairs: DataFrame, alpha: float, params: Params = DEFAULT) -> DataFrame:
    """Changed decisions at one alpha with both selections and every candidate's state.

    ``pairs`` has the selections of both routers as structs ``u`` and ``r``.
    """
    penalty = F.col("lambda")
    rows = pairs.filter((F.abs(F.col("alpha") - alpha) <= 1e-9) & (F.col("u.ord") != F.col("r.ord")))

    def side(name: str, prefix: str) -> list[Column]:
        mean, risk = F.col(f"{name}.mean"), F.col(f"{name}.risk")
        return [mean.alias(f"{prefix}_predicted_mean"), risk.alias(f"{prefix}_risk"),
                rounded(penalty * risk).alias(f"{prefix}_penalty"),
                rounded(mean - penalty * risk).alias(f"{prefix}_risk_adjusted_score"),
                F.col(f"{name}.correct").alias(f"{prefix}_correct"),
                F.col(f"{name}.actual").alias(f"{prefix}_realized_utility")]

    def difference(value: str, name: str) -> Column:
        return rounded(F.col(f"r.{value}") - F.col(f"u.{value}")).alias(f"{name}_difference_risk_minus_utility")

    score = [F.col(f"{s}.mean") - penalty * F.col(f"{s}.risk") for s in ("r", "u")]
    per_candidate = []
    for i, m in enumerate(params.candidates):
        per_candidate += [
            field(i, "mean").alias(f"{m}_predicted_mean"), field(i, "risk").alias(f"{m}_risk"),
            rounded(field(i, "mean") - penalty * field(i, "risk")).alias(f"{m}_risk_adjusted_score"),
            field(i, "correct").alias(f"{m}_correct"), field(i, "actual").alias(f"{m}_realized_utility")]
    return rows.select(
        "query_id", "dataset", "category", "alpha", "lambda",
        F.col("u.model").alias("utility_only_model"), F.col("r.model").alias("risk_aware_model"),
        transition(F.col("u.correct"), F.col("r.correct")).alias("correctness_transition"),
        *side("u", "utility_only"), *side("r", "risk_aware"),
        difference("mean", "predicted_mean"), difference("risk", "risk"),
        rounded(penalty * F.col("r.risk") - penalty * F.col("u.risk")).alias("penalty_difference_risk_minus_utility"),
        rounded(score[0] - score[1]).alias("score_difference_risk_minus_utility"),
        difference("actual", "realized_utility"),
        (F.col("r.risk") < F.col("u.risk")).cast("int").alias("lower_risk_selected"),
        (F.col("r.mean") < F.col("u.mean")).cast("int").alias("lower_mean_selected"),
        ranking(params.k, lambda i: field(i, "mean"), params.candidates).alias("mean_ranking"),
        ranking(params.k, lambda i: field(i, "mean") - penalty * field(i, "risk"), params.candidates)
        .alias("risk_adjusted_ranking"), *per_candidate)


def ordered_details(details: DataFrame) -> DataFrame:
    return details.orderBy(F.desc("realized_utility_difference_risk_minus_utility"), "query_id")


def mechanism_summary(details: DataFrame) -> DataFrame:
    """One row; rates and means are NULL when nothing changed."""
    n = F.count(F.lit(1))
    out = [F.max("alpha").alias("alpha"), F.max("lambda").alias("lambda"), n.alias("changed_decisions")]
    for name in ("lower_risk_selected", "lower_mean_selected"):
        total = F.coalesce(F.sum(name), F.lit(0))
        out += [total.alias(f"{name}_count"), ratio(total, n).alias(f"{name}_rate")]
    for name, column in (("predicted_mean_difference", "predicted_mean"), ("risk_difference", "risk"),
                         ("penalty_difference", "penalty"), ("score_margin", "score"),
                         ("realized_utility_difference", "realized_utility")):
        out.append(mean_of(f"{column}_difference_risk_minus_utility").alias(f"mean_{name}"))
    out += [count_true(F.col("correctness_transition") == t).alias(t) for t in TRANSITIONS]
    return details.agg(*out)


_SUMS = {
    "u_correct": F.col, "r_correct": F.col, "u_cost": F.col, "r_cost": F.col, "u_latency": F.col,
    "r_latency": F.col, "u_realized_utility": F.col, "r_realized_utility": F.col, "u_regret": F.col,
    "r_regret": F.col,
}


def group_comparison(pairs: DataFrame, subject_dataset: str) -> DataFrame:
    """Both routers per (alpha, group): overall, per dataset, and per category of one dataset.

    Queries collapse once, to (alpha, dataset, category); the groups are sums over that small table.
    """
    u, v = F.col("u_realized_utility"), F.col("r_realized_utility")
    fine = pairs.groupBy("alpha", "dataset", "category").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("double").alias(c) for c in _SUMS],
        count_true(F.col("u_selected_ord") == F.col("r_selected_ord")).alias("same"),
        count_true(v > u).alias("r_better"), count_true(u > v).alias("u_better"), count_true(u == v).alias("equal"))
    dataset, category = F.trim("dataset"), F.trim("category")
    subject = F.when((F.lower(dataset) == subject_dataset) & (category != ""), F.struct(
        F.lit("subject").alias("group_type"), category.alias("group_name")))
    labels = F.array_compact(F.array(
        F.struct(F.lit("overall").alias("group_type"), F.lit("overall").alias("group_name")),
        F.struct(F.lit("dataset").alias("group_type"), dataset.alias("group_name")), subject))
    sums = fine.select("*", F.inline(labels)).groupBy("alpha", "group_type", "group_name").agg(
        *[F.sum(c).alias(c) for c in ("n", *_SUMS, "same", "r_better", "u_better", "equal")])
    n = F.col("n")

    def mean(column: str) -> Column:
        return F.col(column) / n

    def sides(column: str, name: str, difference: str | None) -> list[Column]:
        out = [rounded(mean(f"u_{column}")).alias(f"utility_only_{name}"),
               rounded(mean(f"r_{column}")).alias(f"risk_aware_{name}")]
        if difference:
            out.append(rounded(mean(f"r_{column}") - mean(f"u_{column}"))
                       .alias(f"{difference}_difference_risk_minus_utility"))
        return out

    return sums.select(
        "alpha", "group_type", "group_name", n.alias("n_queries"), *sides("correct", "accuracy", "accuracy"),
        *sides("cost", "average_cost", "cost"), *sides("latency", "average_latency", None),
        *sides("realized_utility", "mean_utility", "utility"), *sides("regret", "mean_regret", "regret"),
        F.col("same").alias("same_decision_count"), (n - F.col("same")).alias("changed_decision_count"),
        ratio(n - F.col("same"), n).alias("changed_decision_rate"),
        F.col("r_better").alias("risk_aware_better_count"), F.col("u_better").alias("utility_only_better_count"),
        F.col("equal").alias("equal_utility_count"))


def selection_transitions(pairs: DataFrame) -> DataFrame:
    """Changed decisions per (alpha, from, to): how often better, worse or equal, and by how much."""
    gain = F.round(F.col("r_realized_utility") - F.col("u_realized_utility"), 6)
    loss = F.round(F.col("r_regret") - F.col("u_regret"), 6)
    changed = pairs.filter("u_selected_ord <> r_selected_ord")
    return changed.groupBy("alpha", F.col("u_selected_model").alias("utility_only_model"),
                           F.col("r_selected_model").alias("risk_aware_model")).agg(
        F.count(F.lit(1)).alias("count"), count_true(gain > 0).alias("risk_better_count"),
        count_true(gain < 0).alias("utility_better_count"), count_true(gain == 0).alias("equal_count"),
        mean_of(gain).alias("mean_utility_difference"), mean_of(loss).alias("mean_regret_difference"))
