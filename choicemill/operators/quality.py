"""Completeness, integrity and cost quality: checks return violations as tables.

``require_none`` turns any of them into a failure. Each check is one grouped aggregate or one
anti-join; sets per key are bounded by the number of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.numeric import count_true, rounded
from choicemill.operators.order import exact_quantiles
from choicemill.params import DEFAULT, Params

# The quantiles of the cost report.
COST_QUANTILES = {"median": 0.5, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def require_none(violations: DataFrame, what: str) -> None:
    """Fail when a check found something; looks at one row only."""
    first = violations.first()
    if first is not None:
        raise ValueError(f"{what}: {first.asDict()}")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def duplicate_texts(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Texts that occur more than once per key, with their count.

    One aggregate by digest that keeps one copy of the text: the copies of a task collapse before
    the shuffle, so a text with a third of all rows is one row a task.
    """
    grouped = rows.groupBy(*keys, F.sha2(text, 256).alias("__d")).agg(
        F.min(text).alias(text), F.count(F.lit(1)).alias("occurrences"))
    return grouped.filter("occurrences > 1").drop("__d")


def candidates_found(rows: DataFrame, keys: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    """Per key, its row count and which candidates answered, in candidate order.

    Flags per candidate instead of a collected set: fixed-size state and map-side combine.
    """
    flags = [F.max((F.col("model") == m).cast("int")).alias(f"__f{i}") for i, m in enumerate(params.candidates)]
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *flags)

    def names(value: int) -> Column:
        return F.concat_ws(",", *[F.when(F.coalesce(F.col(f"__f{i}"), F.lit(0)) == value, F.lit(m))
                                  for i, m in enumerate(params.candidates)])

    return grouped.select(*keys, "rows", names(1).alias("found"), names(0).alias("missing"))


def missing_pairs(expected: DataFrame, rows: DataFrame, keys: Sequence[str],
                  params: Params = DEFAULT) -> DataFrame:
    """Expected (key, candidate) pairs without a row."""
    wanted = expected.select(*keys).distinct().withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in params.candidates])))
    return wanted.join(rows.select(*keys, "model").distinct(), [*keys, "model"], "left_anti")


def absent_keys(expected: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")


def completeness(expected: DataFrame, rows: DataFrame, keys: Sequence[str], by: str,
                 params: Params = DEFAULT) -> DataFrame:
    """Per dataset: expected keys, rows, keys lacking a candidate, keys lacking all."""
    found = candidates_found(rows, keys, params)
    wanted = expected.select(by, *keys).distinct()
    joined = wanted.join(found, list(keys), "left")
    gaps = joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("expected"),
        count_true(F.col("rows").isNull() | (F.col("missing") != "")).alias("incomplete"),
        count_true(F.col("rows").isNull()).alias("absent"))
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("observed_rows"))
    return gaps.join(totals, by, "left").withColumn("observed_rows", F.coalesce("observed_rows", F.lit(0)))


def split_violations(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Queries with more than one split, or not exactly one row set of K candidates."""
    found = rows.groupBy("query_id").agg(
        F.count_distinct("split").alias("n_splits"), F.count_distinct("model").alias("n_models"))
    return found.filter((F.col("n_splits") != 1) | (F.col("n_models") != params.k))


def id_report(queries: DataFrame) -> DataFrame:
    """One row: queries, distinct ids, rows with an illegal split label."""
    per_id = queries.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("c"),
        count_true(~F.col("split").isin("train", "validation", "test")).alias("bad"))
    return per_id.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
                      count_true(F.col("c") > 1).alias("duplicate_ids"),
                      F.sum("bad").alias("illegal_splits"))


def side_mismatches(left: DataFrame, right: DataFrame, candidates: str = "", params: Params = DEFAULT) -> DataFrame:
    """Queries only on one side, or on both with different splits; if ``candidates`` names the right side's
    array of candidates, also queries that do not have all of them with an outcome."""
    whole = F.size(F.filter(candidates, lambda c: c["correct"].isNotNull())) == params.k if candidates else F.lit(True)
    joined = left.select("query_id", F.col("split").alias("left_split")).join(
        right.select("query_id", F.col("split").alias("right_split"), whole.alias("__whole")), "query_id", "full_outer")
    reason = (F.when(F.col("right_split").isNull(), "only_left").when(F.col("left_split").isNull(), "only_right")
              .when(F.col("left_split") != F.col("right_split"), "split_differs").when(~F.col("__whole"), "candidates"))
    return joined.withColumn("reason", reason).drop("__whole").filter(F.col("reason").isNotNull())


def selection_problems(summary: DataFrame, queries: DataFrame, split: str) -> DataFrame:
    """Rows of a policy's summary over a split that did not select once for each query; all of them for an empty split."""
    n = queries.filter(F.col("split") == split).agg(F.count(F.lit(1)).alias("__n"))
    return summary.join(F.broadcast(n), F.lit(True)).filter("n_queries <> __n OR __n = 0").withColumnRenamed("__n", "n_expected")


def empty_splits(queries: DataFrame, wanted: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Names of splits that hold no query."""
    named = queries.sparkSession.createDataFrame([(s,) for s in wanted], "split string")
    return named.join(queries.select("split").distinct(), "split", "left_anti")


def null_metrics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a result that hold a NULL where none may be."""
    return null_counts(rows, columns).filter("nulls > 0")


def non_finite(rows: DataFrame, key: str, columns: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Rows with a NaN, infinite or missing feature."""
    def bad(value: Column) -> Column:
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    conditions = [bad(F.col(c).cast("double")) for c in columns]
    conditions += [F.col(a).isNull() | F.exists(a, lambda x: bad(x.cast("double"))) for a in arrays]
    any_bad = conditions[0]
    for condition in conditions[1:]:
        any_bad = any_bad | condition
    return rows.filter(any_bad).select(key)


def cost_distribution(rows: DataFrame, cost: str = "raw_cost", params: Params = DEFAULT,
                      spread: bool | None = None) -> DataFrame:
    """One row: count, minimum, interpolated quantiles, maximum."""
    quantiles = exact_quantiles(rows, [], cost, list(COST_QUANTILES.values()), params, spread)
    bounds = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min(cost).alias("min_cost"),
                      F.max(cost).alias("max_cost"))
    one = quantiles.withColumn("one", F.lit(1)).join(bounds.withColumn("one", F.lit(1)), "one")
    return one.select("n_rows", rounded("min_cost").alias("min_cost"),
                      *[rounded(F.col("q")[i]).alias(f"{name}_cost") for i, name in enumerate(COST_QUANTILES)],
                      rounded("max_cost").alias("max_cost"))


def zero_costs(rows: DataFrame, cost: str = "raw_cost") -> DataFrame:
    return (rows.filter(F.col(cost) == 0).groupBy("dataset", "model")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def most_expensive(rows: DataFrame, keys: Sequence[str], cost: str = "raw_cost", top: int = 10) -> DataFrame:
    """The top rows by cost, ties by key; each task keeps only its own top rows."""
    return rows.orderBy(F.desc(cost), *keys).limit(top)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a one-to-one join: repeated on a side, or without a partner."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    joined = side(left, "n_left").join(side(right, "n_right"), list(keys), "full_outer")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right")]
    return joined.select(*keys, *counts).filter("n_left <> 1 OR n_right <> 1")


def label_conflicts(rows: DataFrame, key: str = "query_id", label: str = "category") -> DataFrame:
    """Keys whose rows disagree on a label."""
    found = rows.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return found.filter("low <> high").select(key)


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of NULLs; one aggregate over the table."""
    counted = rows.agg(*[count_true(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])))
