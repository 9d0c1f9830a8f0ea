"""Cost conditioning fitted on training rows, and utility for every cost weight.

Works on the nested table (one row per query, K candidates in ``cands``): the fits are small
aggregates over training rows, and applying them is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.candidates import item
from choicemill.operators.order import attach, exact_quantiles, settled
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import fits, row_bound, with_row_bound


@dataclass(frozen=True)
class CostRange:
    """Clip threshold and range of the training costs: one row, so kept as plain numbers."""

    clip_threshold: float
    low: float
    high: float


def long_costs(nested: DataFrame) -> DataFrame:
    """(dataset, model, raw_cost) of training rows; only the cost field is read."""
    fields = F.transform("cands", lambda c: F.struct(c["model"].alias("model"), c["raw_cost"].alias("raw_cost")))
    return nested.filter(F.col("split") == "train").select("dataset", F.inline(fields))


def train_medians(nested: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Median of positive training costs per (dataset, model)."""
    positive = long_costs(nested).filter("raw_cost > 0")
    if spread is None:
        spread = not fits(nested, params.small_rows // params.k)
    medians = exact_quantiles(positive, ["dataset", "model"], "raw_cost", [0.5], params, spread)
    return medians.select("dataset", "model", F.col("q")[0].alias("median_cost"))


def with_clean_costs(nested: DataFrame, medians: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Replace costs <= 0 by the training median of their (dataset, model) and flag them.

    A non-positive cost without a median fails the job.
    """
    per_dataset = medians.groupBy("dataset").agg(*[
        F.max(F.when(F.col("model") == m, F.col("median_cost"))).alias(f"__median_{i}")
        for i, m in enumerate(params.candidates)])
    # At most one row per row of the written medians, so their count bounds it.
    per_dataset = with_row_bound(per_dataset, row_bound(medians))
    joined = attach(nested, per_dataset, ["dataset"], "query_id", "left", params)

    def clean(i: int) -> Column:
        raw, median = item(i, "raw_cost"), F.col(f"__median_{i}")
        missing = F.raise_error(F.concat(F.lit("no training median for "), F.col("dataset"),
                                         F.lit(" / " + params.candidates[i]))).cast("double")
        return F.when(raw > 0, raw).when(median.isNotNull(), median).otherwise(missing)

    cands = F.array(*[
        F.struct(F.col("cands")[i].alias("base"), (~F.coalesce(item(i, "raw_cost") > 0, F.lit(False))).cast("int").alias("cost_imputed"),
                 clean(i).alias("cost_clean")) for i in range(params.k)])
    cleaned = joined.withColumn("cands", cands).drop(*[f"__median_{i}" for i in range(params.k)])
    return with_row_bound(cleaned, row_bound(nested))


def fit_cost_range(cleaned: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """One row: clip threshold (P99 of clean training costs), and range after clipping.

    Clipping is monotone, so the range of the clipped costs follows from the range of the clean
    ones and needs no further pass.
    """
    costs = (cleaned.filter(F.col("split") == "train")
             .select(F.explode(F.transform("cands", lambda c: c["cost_clean"])).alias("cost_clean")))
    if spread is None:
        spread = not fits(cleaned, params.small_rows // params.k)
    if spread:
        costs = settled(costs)
    threshold = exact_quantiles(costs, [], "cost_clean", [params.clip_percentile], params, spread)
    bounds = costs.agg(F.min("cost_clean").alias("lo"), F.max("cost_clean").alias("hi"))
    one = threshold.select(F.col("q")[0].alias("clip_threshold"), F.lit(1).alias("one"))
    return (one.join(bounds.withColumn("one", F.lit(1)), "one")
            .select("clip_threshold", F.least("lo", "clip_threshold").alias("normalization_min"),
                    F.least("hi", "clip_threshold").alias("normalization_max")))


def read_cost_range(fitted: DataFrame) -> CostRange:
    row = fitted.first()
    return CostRange(row["clip_threshold"], row["normalization_min"], row["normalization_max"])


def conditioned(cleaned: DataFrame, cost: CostRange, params: Params = DEFAULT) -> DataFrame:
    """Winsorise, scale to [0, 1] and compute the utilities; a projection per query.

    ``utilities`` holds one value per alpha, rounded to six decimals, in the order of the grid.
    """
    span = cost.high - cost.low

    # One transform for each step: a candidate's value is computed once and read by the next step. Written out for all
    # candidates, the steps grow into one method that the JVM does not compile.
    def clipped(c: Column) -> Column:
        return F.struct(c["base"].alias("base"), c["cost_imputed"].alias("cost_imputed"), c["cost_clean"].alias("cost_clean"),
                        F.least(c["cost_clean"], F.lit(cost.clip_threshold)).alias("cost_clipped"))

    def scaled(c: Column) -> Column:
        value = F.lit(0.0) if span == 0 else (c["cost_clipped"] - F.lit(cost.low)) / F.lit(span)
        return F.struct(c.alias("c"), value.alias("scaled"))

    def bounded(c: Column) -> Column:
        return F.struct(c["c"].alias("c"), c["scaled"].alias("scaled"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["scaled"])).alias("bounded"))

    def fields(each: Column) -> Column:
        c, base = each["c"], each["c"]["base"]
        utilities = [F.round(base["correct"].cast("double") - F.lit(a) * each["bounded"], 6) for a in params.alphas]
        return F.struct(
            base["model"].alias("model"), base["ord"].alias("ord"), base["correct"].alias("correct"),
            base["latency"].alias("latency"), base["raw_cost"].alias("raw_cost"),
            c["cost_imputed"].alias("cost_imputed"), c["cost_clean"].alias("cost_clean"),
            (c["cost_clean"] > F.lit(cost.clip_threshold)).cast("int").alias("cost_winsorized"),
            c["cost_clipped"].alias("cost_clipped"), each["bounded"].alias("normalized_cost"),
            (each["bounded"] != each["scaled"]).cast("int").alias("normalization_clipped"),
            F.array(*utilities).alias("utilities"))

    cands = F.col("cands")
    for step in (clipped, scaled, bounded, fields):
        cands = F.transform(cands, step)
    return cleaned.withColumn("cands", cands)


def utility_rows(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Long output table: one row per (query, model), costs to 8 and the rest to 6 decimals."""
    long = core.select("query_id", "dataset", "category", "split", F.inline("cands"))
    return long.select(
        "query_id", "dataset", "category", "split", "model", "correct", "latency",
        F.round("raw_cost", 8).alias("raw_cost"), "cost_imputed", F.round("cost_clean", 8).alias("cost_clean"),
        "cost_winsorized", F.round("cost_clipped", 8).alias("cost_clipped"),
        F.round("normalized_cost", 6).alias("normalized_cost"), "normalization_clipped", "utilities")


def utility_by_alpha(core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per (query, model, alpha)."""
    pairs = F.arrays_zip(F.array(*[F.lit(a) for a in params.alphas]).alias("alpha"),
                         F.col("utilities").alias("utility"))
    long = core.select("query_id", "dataset", "category", "split", F.inline("cands"))
    return (long.withColumn("__p", F.explode(pairs))
            .select("query_id", "dataset", "category", "split", "model", "ord", "correct", "latency",
                    "raw_cost", "cost_clean", F.col("__p.alpha").alias("alpha"),
                    F.col("__p.utility").alias("utility")))


def cost_parameters(medians: DataFrame, fitted: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Parameters as long rows (name, value), one per fitted number."""
    named = medians.select(F.concat_ws("__", F.lit("median"), "dataset", "model").alias("name"),
                           F.col("median_cost").alias("value"))
    fields = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value"))
              for c in ("clip_threshold", "normalization_min", "normalization_max")]
    return named.unionByName(fitted.select(F.inline(F.array(*fields))))
