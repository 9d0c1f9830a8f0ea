"""Between one column per candidate and one row per candidate, for tables that arrive wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.params import DEFAULT, Params


def _required(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def long_predictions(wide: DataFrame, keys: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    """Mean and risk columns per candidate to one row per candidate; a narrow expansion."""
    pairs = [(f"mean_utility_{m}", f"risk_{m}") for m in params.candidates]
    _required(wide, [c for pair in pairs for c in pair])
    rows = [F.struct(F.lit(m).alias("model"), F.col(mean).alias("predicted_utility"), F.col(risk).alias("predictive_risk"))
            for m, (mean, risk) in zip(params.candidates, pairs, strict=True)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def long_utilities(wide: DataFrame, keys: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    """One utility column per alpha to one row per alpha."""
    names = [f"utility_alpha_{a}" for a in params.alphas]
    _required(wide, names)
    rows = [F.struct(F.lit(a).alias("alpha"), F.col(f"`{name}`").alias("realised_utility"))
            for a, name in zip(params.alphas, names, strict=True)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def wide_candidates(long: DataFrame, keys: Sequence[str], values: Sequence[str], params: Params = DEFAULT) -> DataFrame:
    """One column per candidate and value; the candidate list is given, so no pass looks for it."""
    pivoted = long.groupBy(*keys).pivot("model", list(params.candidates))
    wide = pivoted.agg(*[F.max(v).alias(v) for v in values])
    if len(values) == 1:
        return wide.select(*keys, *[F.col(m).alias(f"{values[0]}_{m}") for m in params.candidates])
    return wide.select(*keys, *[F.col(f"{m}_{v}").alias(f"{v}_{m}") for v in values for m in params.candidates])
