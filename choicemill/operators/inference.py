"""Paired comparison of two routers: bootstrap intervals and the exact McNemar test."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions.hashing import POISSON_STEPS, UNIFORM_LANES
from choicemill.functions.numeric import count_true, mean_of, rounded
from choicemill.operators.order import hex_bucket
from choicemill.params import DEFAULT, Params

PAIR_FIELDS = ("selected_model", "selected_ord", "correct", "cost", "latency", "realized_utility", "regret")


def router_key(name: Column) -> Column:
    """Canonical router of a free-form name: 'risk' decides first, then the marks of no penalty."""
    text = F.lower(F.trim(name))
    plain = text.contains("utility") | text.contains("lambda=0") | text.contains("lambda_0")
    return F.when(text.contains("risk"), "risk_aware").when(plain, "utility_only")


def pair_decisions(decisions: DataFrame) -> DataFrame:
    """One row per (query, alpha) that both routers decided; fields prefixed ``u_`` and ``r_``."""
    rows = decisions.withColumn("__k", router_key(F.col("router")))
    sides = (("u", "utility_only"), ("r", "risk_aware"))
    picked = rows.groupBy("query_id", "dataset", "category", "alpha_id", "alpha").agg(*[
        F.max(F.when(F.col("__k") == router, F.col(f))).alias(f"{side}_{f}")
        for side, router in sides for f in PAIR_FIELDS])
    return picked.filter("u_selected_ord IS NOT NULL AND r_selected_ord IS NOT NULL")


DIFFERENCES = {"accuracy": "correct", "utility": "realized_utility", "regret": "regret"}


def _nested_differences(pairs: DataFrame, params: Params) -> DataFrame:
    """One row per query: the three differences r - u of every alpha, NULL where there is no pair."""
    return pairs.groupBy("query_id").agg(*[
        F.max(F.when(F.col("alpha_id") == a, (F.col(f"r_{f}") - F.col(f"u_{f}")).cast("double"))).alias(f"{name}_{a}")
        for a in range(len(params.alphas)) for name, f in DIFFERENCES.items()])


def resampling_units(pairs: DataFrame, params: Params = DEFAULT, buckets: bool = False) -> DataFrame:
    """unit, and what it adds to each sum: the rows that are resampled, one per query or per hash bucket."""
    rows = _nested_differences(pairs, params)
    sums = []
    for a in range(len(params.alphas)):
        have = F.col(f"accuracy_{a}").isNotNull()
        sums.append((have.cast("long"), f"n_{a}"))
        sums += [(F.col(f"{name}_{a}"), f"{name}_{a}") for name in DIFFERENCES]
    if buckets:
        return rows.groupBy(hex_bucket("query_id").cast("string").alias("unit")).agg(
            *[F.sum(value).alias(name) for value, name in sums])
    return rows.select(F.col("query_id").alias("unit"), *[value.alias(name) for value, name in sums])


def resampled_sums(units: DataFrame, prefix: str, draws: int) -> DataFrame:
    """b, and the sums of every other column over resample b, for draws 0..draws-1.

    Every unit has its own Poisson(1) weight in every resample, equal to that of ``with_draw_weights``. A task
    multiplies a block of weights with the block's values and gives one row a resample, whatever its rows.
    """
    names = [c for c in units.columns if c != "unit"]
    groups = -(-draws // UNIFORM_LANES)
    limits = np.array([math.ceil(step * 2 ** 52) for step in POISSON_STEPS], dtype=np.uint64)
    # The leading 16 bits settle nearly every draw; those that a step cuts are compared in full.
    firsts = np.arange(1 << 16, dtype=np.uint64) << np.uint64(36)
    low = np.searchsorted(limits, firsts, "right")
    cut = low != np.searchsorted(limits, firsts + np.uint64((1 << 36) - 1), "right")
    table = np.where(cut, -1.0, low)
    starts = [f"{prefix}|{g}|".encode() for g in range(groups)]
    block = 32

    def weights(keys: list[bytes]) -> np.ndarray:
        digests = b"".join([hashlib.sha256(start + key).digest() for key in keys for start in starts])
        a, b, c, d = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(len(keys), groups, 4).transpose(2, 0, 1)

        def bits(word: np.ndarray, kept: int) -> np.ndarray:
            return word & np.uint64((1 << kept) - 1)

        def up(word: np.ndarray, by: int) -> np.ndarray:
            return word << np.uint64(by)

        def down(word: np.ndarray, by: int) -> np.ndarray:
            return word >> np.uint64(by)

        # Four numbers of 13 hex digits, 52 bits, follow one another in a digest.
        lanes = np.stack([down(a, 12), up(bits(a, 12), 40) | down(b, 24), up(bits(b, 24), 28) | down(c, 36),
                          up(bits(c, 36), 16) | down(d, 48)], axis=-1).reshape(len(keys), -1)[:, :draws]
        found = table[down(lanes, 36)]
        open_ = found < 0
        found[open_] = np.searchsorted(limits, lanes[open_], "right")
        return found

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((draws, len(names))), np.zeros(len(names), dtype=bool)
        for batch in batches:
            keys = [key.encode() for key in batch.column("unit").to_pylist()]
            columns = [batch.column(name).cast(pa.float64()) for name in names]
            seen |= [column.null_count < len(column) for column in columns]
            values = np.column_stack([column.fill_null(0.0).to_numpy(zero_copy_only=False) for column in columns])
            for at in range(0, len(keys), block):
                w, v = weights(keys[at:at + block]), values[at:at + block]
                if np.isfinite(v).all():
                    total += w.T @ v
                else:  # a value with weight 0 must not count
                    for row, value in zip(w, v, strict=True):
                        total[row > 0] += row[row > 0, None] * value
        if seen.any():
            arrays = [pa.array(total[:, i]) if here else pa.nulls(draws, pa.float64()) for i, here in enumerate(seen)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), *arrays], ["b", *names])

    # Few rows become many here: a fixed number of partitions keeps adaptive execution from merging
    # the small input into one task.
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = units.repartition(tasks).mapInArrow(partial, ", ".join(["b int", *[f"{c} double" for c in names]]))
    return parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in names])


def bootstrap_intervals(pairs: DataFrame, params: Params = DEFAULT, buckets: bool = False) -> DataFrame:
    """Percentile 95% intervals of the mean differences per alpha.

    Resample b gives each query a Poisson(1) weight drawn from (b, query), the same for all alphas
    and metrics. Draws exist only inside a task: the shuffle holds one row per (task, b). With ``buckets``
    the differences are first summed in 4,096 hash buckets and the buckets are resampled, so the number
    of draws no longer grows with the queries.
    """
    alphas = range(len(params.alphas))
    totals = resampled_sums(resampling_units(pairs, params, buckets), f"ci{params.seed}", params.resamples)
    means = totals.select("b", F.inline(F.array(*[
        F.struct(F.lit(params.alphas[a]).alias("alpha"), *[
            F.try_divide(F.col(f"{name}_{a}"), F.col(f"n_{a}")).alias(name) for name in DIFFERENCES])
        for a in alphas])))
    # One value per resample and metric: bounded by the number of resamples.
    ends = F.array(F.lit(0.025), F.lit(0.975))
    limits = means.groupBy("alpha").agg(*[F.percentile(name, ends).alias(name) for name in DIFFERENCES])
    return limits.select("alpha", *[
        rounded(F.col(name)[i]).alias(f"{name}_ci_{end}") for name in DIFFERENCES
        for i, end in enumerate(("lower", "upper"))])


def _log_factorial(x: Column) -> Column:
    """ln x!: Stirling's series at x + 10, where it is exact to a double, less the ten factors in between."""
    y = x.cast("double") + 10
    series = (y * F.ln(y) - y + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * y) + 1 / (12 * y) - 1 / (360 * y * y * y)
              + 1 / (1260 * y * y * y * y * y))
    factors = None
    for j in range(1, 11):
        factor = x.cast("double") + j
        factors = factor if factors is None else factors * factor
    return series - F.ln(factors)


def mcnemar_p(a: Column, b: Column) -> Column:
    """Exact two-sided p of a binomial(a + b, 1/2) at min(a, b); 1 without discordant pairs.

    The tail is summed downwards from its largest term. Terms 20 sqrt(n) and more below the largest are
    smaller by exp(-800) and cannot change a double, so the sum never looks at more.
    """
    n, k = (a + b).cast("long"), F.least(a, b).cast("long")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n.cast("double") * F.lit(math.log(2.0)))
    count = F.least(k, F.ceil(F.lit(20.0) * F.sqrt(n.cast("double"))).cast("long"))

    def down(acc: Column, i: Column) -> Column:
        at = (k - i + 1).cast("double")
        term = acc["term"] * at / (n.cast("double") - at + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    # An empty range must stay empty: sequence(1, 0) would count down.
    steps = F.filter(F.sequence(F.lit(0).cast("long"), count), lambda i: i > 0)
    tail = F.aggregate(steps, F.struct(top.alias("term"), top.alias("total")), down)["total"]
    return F.when((n == 0) | (a == b), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def discordant(pairs: DataFrame) -> DataFrame:
    """Per alpha: pairs that only one router got right, and the McNemar p."""
    counts = pairs.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n_queries"),
        count_true((F.col("u_correct") == 1) & (F.col("r_correct") == 0)).alias("utility_only_accuracy_wins"),
        count_true((F.col("u_correct") == 0) & (F.col("r_correct") == 1)).alias("risk_aware_accuracy_wins"))
    p = mcnemar_p(F.col("utility_only_accuracy_wins"), F.col("risk_aware_accuracy_wins"))
    return counts.withColumn("mcnemar_p_value", rounded(p))


def mean_differences(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("alpha").agg(*[
        mean_of((F.col(f"r_{f}") - F.col(f"u_{f}")).cast("double")).alias(f"{name}_difference_risk_minus_utility")
        for name, f in DIFFERENCES.items()])


def paired_tests(pairs: DataFrame, params: Params = DEFAULT, buckets: bool = False) -> DataFrame:
    """One row per alpha: differences, intervals, discordant counts and p. All parts are tiny."""
    out = discordant(pairs).join(mean_differences(pairs), "alpha")
    return out.join(bootstrap_intervals(pairs, params, buckets), "alpha")
