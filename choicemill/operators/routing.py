"""Routing decisions from a routing state, their summaries, and the choice of the risk penalty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.candidates import argmax, item
from choicemill.functions.numeric import count_true, mean_of, rounded
from choicemill.params import DEFAULT, Params

STATE_FIELDS = ("model", "ord", "mean", "risk", "actual", "correct", "cost", "latency")


def field(i: int, name: str) -> Column:
    return item(i, name, "state")


def selected(penalty: Column | float, params: Params = DEFAULT) -> Column:
    """Struct of the candidate with the highest mean - penalty * risk; first candidate on a tie."""
    weight = F.lit(penalty) if isinstance(penalty, float) else penalty
    return argmax(params.k, lambda i: field(i, "mean") - weight * field(i, "risk"),
                  lambda i: {name: field(i, name) for name in STATE_FIELDS})


def state_of(ordinal: Column) -> Column:
    return F.get(F.col("state"), ordinal)


def decisions(state: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Decision rows for a state that carries a ``lambda`` column (and possibly ``router``)."""
    rows = state.withColumn("__s", selected(F.col("lambda"), params))
    extra = [c for c in ("router",) if c in state.columns]
    return rows.select(
        "query_id", "dataset", "category", "alpha_id", "alpha", "lambda", *extra,
        F.col("__s.model").alias("selected_model"), F.col("__s.ord").alias("selected_ord"),
        F.col("__s.mean").alias("selected_mean_utility"), F.col("__s.risk").alias("selected_risk"),
        F.col("disagreement").alias("decision_disagreement"), F.col("entropy").alias("decision_entropy"),
        F.col("__s.actual").alias("realized_utility"), "oracle_model", "oracle_utility",
        F.round(F.col("oracle_utility") - F.col("__s.actual"), 6).alias("regret"),
        F.col("__s.correct").alias("correct"), F.col("__s.cost").alias("cost"),
        F.col("__s.latency").alias("latency"))


def with_lambdas(state: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """Every penalty of the grid for every row: a narrow expansion by a literal array."""
    return state.withColumn("lambda", F.explode(F.array(*[F.lit(x) for x in lambdas])))


def summarise(rows: DataFrame, keys: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_queries"), mean_of("correct").alias("accuracy"),
        mean_of("cost").alias("average_cost"), mean_of("latency").alias("average_latency"),
        mean_of("realized_utility").alias("mean_realized_utility"),
        mean_of("oracle_utility").alias("mean_oracle_utility"), mean_of("regret").alias("mean_regret"),
        mean_of("selected_risk").alias("mean_selected_risk"),
        mean_of("decision_disagreement").alias("mean_decision_disagreement"),
        *[count_true(F.col("selected_model") == m).alias(f"{m}_selected") for m in params.candidates])


def lambda_sweep(validation: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Summary per (alpha, lambda); the expanded rows exist only before the partial aggregate."""
    return summarise(decisions(with_lambdas(validation, params.lambdas), params), ["alpha", "lambda"], params)


def best_lambdas(sweep: DataFrame) -> DataFrame:
    """Per alpha, the row with the least mean regret; the smaller penalty on a tie."""
    others = [c for c in sweep.columns if c != "alpha"]
    best = F.min_by(F.struct(*others), F.struct("mean_regret", "lambda")).alias("b")
    return sweep.groupBy("alpha").agg(best).select("alpha", "b.*")


def two_routers(test: DataFrame, chosen: DataFrame) -> DataFrame:
    """State rows once per router: no penalty, and the frozen penalty of the alpha.

    ``chosen`` has one row per alpha.
    """
    frozen = F.broadcast(chosen.select("alpha", F.col("lambda").alias("__frozen")))
    routers = F.array(
        F.struct(F.lit("utility_only").alias("router"), F.lit(0.0).alias("lambda")),
        F.struct(F.lit("risk_aware").alias("router"), F.col("__frozen").alias("lambda")))
    joined = test.join(frozen, "alpha")
    return joined.select(*test.columns, F.inline(routers))


def both_selections(test: DataFrame, chosen: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per (query, alpha) with the selections of both routers as structs ``u`` and ``r``."""
    frozen = F.broadcast(chosen.select("alpha", "lambda"))
    rows = test.join(frozen, "alpha")
    return rows.withColumn("u", selected(0.0, params)).withColumn("r", selected(F.col("lambda"), params))


def wide_state(pairs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Routing state rows with one column per candidate and the differences of both selections."""
    penalty = F.col("lambda")
    wide = []
    for i, m in enumerate(params.candidates):
        wide += [field(i, "mean").alias(f"mean_utility_{m}"), field(i, "risk").alias(f"risk_{m}"),
                 rounded(field(i, "mean") - penalty * field(i, "risk")).alias(f"risk_adjusted_score_{m}")]
    u_score = F.col("u.mean") - penalty * F.col("u.risk")
    r_score = F.col("r.mean") - penalty * F.col("r.risk")
    return pairs.select(
        "query_id", "dataset", "category", "alpha", "lambda", *wide,
        F.col("u.model").alias("utility_only_model"), F.col("r.model").alias("risk_aware_model"),
        (F.col("u.ord") != F.col("r.ord")).cast("int").alias("decision_changed"),
        F.col("u.mean").alias("utility_only_selected_mean"), F.col("u.risk").alias("utility_only_selected_risk"),
        F.col("r.mean").alias("risk_aware_selected_mean"), F.col("r.risk").alias("risk_aware_selected_risk"),
        rounded(F.col("r.mean") - F.col("u.mean")).alias("selected_mean_difference_risk_minus_utility"),
        rounded(F.col("r.risk") - F.col("u.risk")).alias("selected_risk_difference_risk_minus_utility"),
        rounded(u_score).alias("utility_only_model_risk_adjusted_score"),
        rounded(r_score).alias("risk_aware_model_risk_adjusted_score"),
        rounded(r_score - u_score).alias("risk_adjusted_score_margin"))
