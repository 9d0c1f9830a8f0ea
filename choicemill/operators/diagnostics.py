"""How well ensemble risk and vote signals tell errors and regret."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemill.functions.candidates import argmax
from choicemill.functions.numeric import mean_of, mean_where, rounded
from choicemill.operators.order import (
    null_safe_join,
    settled,
    skew_join,
    tail_flags,
    value_ranks,
    with_average_rank,
)
from choicemill.operators.routing import field, selected
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import fits, row_bound, with_row_bound


def _undefined_when_constant(value: Column, n: Column, *spans: Column) -> Column:
    ok = n >= 2
    for span in spans:
        ok = ok & (span > 0)
    return rounded(F.when(ok, value))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, params: Params = DEFAULT,
             spread: bool | None = None) -> DataFrame:
    """Rank correlation per key: (keys, n, rho); NULL for fewer than two rows or a constant side."""
    if spread is None:
        spread = not fits(rows.select(x), params.small_rows)
    if not spread:
        ranked = with_average_rank(with_average_rank(rows, keys, x, "__rx"), keys, y, "__ry")
        # corr() fails on a constant side under ANSI rules; its parts do not.
        parts = ranked.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.covar_pop("__rx", "__ry").alias("__c"),
            F.stddev_pop("__rx").alias("__sx"), F.stddev_pop("__ry").alias("__sy"))
        rho = F.try_divide(F.col("__c"), F.col("__sx") * F.col("__sy"))
        return parts.select(*keys, "n", _undefined_when_constant(
            rho, F.col("n"), F.col("__sx"), F.col("__sy")).alias("rho"))
    # Pairs collapse to their multiplicity; ranks come from the distinct values of each side.
    joint = settled(rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__m")))
    for side, name in ((x, "__rx"), (y, "__ry")):
        counts = joint.groupBy(*keys, side).agg(F.sum("__m").alias("n"), F.count(F.lit(1)).alias("__pairs"))
        counts = settled(counts)
        ranks = value_ranks(counts, keys, side, "n", params).select(*keys, side, F.col("rank").alias(name))
        joint = skew_join(joint, ranks, [*keys, side], counts, "__pairs", F.col(y if side == x else x))
    m, rx, ry = F.col("__m"), F.col("__rx"), F.col("__ry")
    sums = joint.groupBy(*keys).agg(
        F.sum(m).alias("n"), F.sum(m * rx).alias("sx"), F.sum(m * ry).alias("sy"),
        F.sum(m * rx * rx).alias("sxx"), F.sum(m * ry * ry).alias("syy"), F.sum(m * rx * ry).alias("sxy"),
        (F.max(rx) - F.min(rx)).alias("dx"), (F.max(ry) - F.min(ry)).alias("dy"))
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    rho = F.try_divide(cov, F.sqrt(vx * vy))
    return sums.select(*keys, "n", _undefined_when_constant(rho, n, F.col("dx"), F.col("dy")).alias("rho"))


def model_errors(state: DataFrame) -> DataFrame:
    """Long (query, alpha, model): risk and absolute error of the mean prediction."""
    long = state.select("query_id", "alpha", F.inline("state"))
    return long.select("query_id", "alpha", "model", "risk", F.abs(F.col("mean") - F.col("actual")).alias("error"))


def model_level_signals(state: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Rank correlation of risk with error, pooled and per candidate, and the error at both ends."""
    errors = model_errors(state)
    if spread is None:
        spread = not fits(state, params.small_rows // params.k)
    pooled = spearman(errors, ["alpha"], "risk", "error", params, spread).select(
        "alpha", F.lit("model_level_std_all_models").alias("signal"), "n", F.col("rho").alias("spearman_rho"))
    rho = spearman(errors, ["alpha", "model"], "risk", "error", params, spread)
    tails = tail_flags(errors, ["alpha", "model"], "risk", params.tail_fraction, "query_id", params, spread)
    ends = tails.groupBy("alpha", "model").agg(
        mean_where(F.col("error"), F.col("in_low")).alias("low_20_mean_error"),
        mean_where(F.col("error"), F.col("in_high")).alias("high_20_mean_error"))
    per_model = null_safe_join(rho, ends, ["alpha", "model"]).select(
        "alpha", F.concat(F.lit("model_level_std_"), "model").alias("signal"), "n",
        F.col("rho").alias("spearman_rho"), "low_20_mean_error", "high_20_mean_error")
    both = pooled.unionByName(per_model, allowMissingColumns=True)
    return both.withColumn("analysis", F.lit("model_level_prediction_error"))


# The names of the routing signals.
SIGNALS = {"selected_model_std": "selected_risk", "decision_disagreement": "disagreement",
           "decision_entropy": "entropy"}


def routing_records(state: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The choice without penalty, its regret and the three signals, per (query, alpha)."""
    chosen = selected(0.0, params)
    best = argmax(params.k, lambda i: field(i, "actual"), lambda i: {"model": field(i, "model")})
    rows = state.withColumn("__s", chosen).withColumn("__b", best).select(
        "query_id", "dataset", "category", "alpha", F.col("__s.model").alias("selected_model"),
        F.col("__b.model").alias("oracle_model"),
        F.round(F.col("__b.score") - F.col("__s.actual"), 6).alias("regret"),
        F.col("__s.risk").alias("selected_risk"), "disagreement", "entropy")
    return with_row_bound(rows, row_bound(state))


def signal_rows(records: DataFrame) -> DataFrame:
    """One row per (record, signal)."""
    entries = F.array(*[F.struct(F.lit(name).alias("signal"), F.col(c).alias("value"))
                        for name, c in SIGNALS.items()])
    return records.select("query_id", "alpha", "regret", F.inline(entries))


def _auroc(rank_sum: Column, positives: Column, n: Column) -> Column:
    """Area under the ROC curve from average ranks; NULL with one class only."""
    p, q = positives.cast("double"), (n - positives).cast("double")
    return rounded(F.when((p > 0) & (q > 0), F.try_divide(rank_sum - p * (p + 1) / 2, p * q)))


def routing_signals(records: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Each (alpha, signal, failure threshold): rank correlation, AUROC, failure and regret at both ends."""
    rows = signal_rows(records)
    keys = ["alpha", "signal"]
    if spread is None:
        spread = not fits(records, params.small_rows // len(SIGNALS))
    rho = spearman(rows, keys, "value", "regret", params, spread)
    flagged = tail_flags(rows, keys, "value", params.tail_fraction, "query_id", params, spread)
    low, high, regret = F.col("in_low"), F.col("in_high"), F.col("regret")
    metrics = [mean_where(regret, low).alias("low_20_mean_regret"),
               mean_where(regret, high).alias("high_20_mean_regret")]
    positives = []
    for j, t in enumerate(params.failure_thresholds):
        failed = (regret > t).cast("int")
        metrics += [mean_of(failed).alias(f"fail{j}"), mean_where(failed, low).alias(f"low{j}"),
                    mean_where(failed, high).alias(f"high{j}")]
        positives.append(failed)
    ends = flagged.groupBy(*keys).agg(*metrics)
    # Ranks are a property of the distinct values: counts per value carry all AUROC needs.
    counts = rows.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("m"), *[F.sum(p).alias(f"p{j}") for j, p in enumerate(positives)])
    if spread:
        ranks = value_ranks(settled(counts), keys, "value", "m", params)
    else:
        running = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranks = counts.withColumn("rank", F.sum("m").over(running) - (F.col("m") - 1) / F.lit(2.0))
    areas = ranks.groupBy(*keys).agg(F.sum("m").alias("__n"), *[
        c for j in range(len(positives))
        for c in (F.sum(f"p{j}").alias(f"__p{j}"), F.sum(F.col(f"p{j}") * F.col("rank")).alias(f"__r{j}"))])
    joined = null_safe_join(null_safe_join(rho, ends, keys), areas, keys)
    per_threshold = F.array(*[
        F.struct(F.lit(t).alias("failure_threshold"),
                 _auroc(F.col(f"__r{j}"), F.col(f"__p{j}"), F.col("__n")).alias("auroc"),
                 F.col(f"fail{j}").alias("failure_rate"), F.col(f"low{j}").alias("low_20_failure_rate"),
                 F.col(f"high{j}").alias("high_20_failure_rate"))
        for j, t in enumerate(params.failure_thresholds)])
    return joined.select(F.lit("routing_uncertainty").alias("analysis"), *keys, "n",
                         F.col("rho").alias("spearman_rho"), "low_20_mean_regret", "high_20_mean_regret",
                         F.inline(per_threshold))
