"""Expressions over the candidate array: K structs in candidate order, one array per query.

K is a parameter, so elements are addressed by position. That keeps every expression inside
generated code, where lambdas over arrays would be interpreted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(obs: DataFrame, keys: Sequence[str], values: Sequence[str], candidates: Sequence[str],
             name: str = "cands") -> DataFrame:
    """Long to nested: one row per key with the candidates' values in candidate order.

    One shuffle by key. The state per key is K times the values, whatever the number of rows,
    and partial aggregation runs before the shuffle. Needs (key, model) to be unique.
    """
    aggregates = [
        F.max(F.when(F.col("model") == c, F.col(v))).alias(f"__{v}_{i}")
        for i, c in enumerate(candidates) for v in values
    ]
    structs = [
        F.struct(F.lit(c).alias("model"), F.lit(i).alias("ord"),
                 *[F.col(f"__{v}_{i}").alias(v) for v in values])
        for i, c in enumerate(candidates)
    ]
    return obs.groupBy(*keys).agg(*aggregates).select(*keys, F.array(*structs).alias(name))


def lengthen(df: DataFrame, name: str = "cands") -> DataFrame:
    """Nested to long: one row per (key, candidate); no shuffle."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.inline(name))


def argmax(k: int, score: Callable[[int], Column], payload: Callable[[int], dict[str, Column]]) -> Column:
    """Struct of the candidate with the highest score; the first candidate wins a tie."""
    return F.greatest(*[
        F.struct(score(i).alias("score"), F.lit(-i).alias("neg_ord"),
                 *[value.alias(field) for field, value in payload(i).items()])
        for i in range(k)
    ])


def item(i: int, field: str, name: str = "cands") -> Column:
    """Field of the i-th candidate. The field comes first, so that only it is read from storage."""
    return F.col(f"{name}.{field}")[i]


def literals(values: Sequence, kind: str = "double") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def ranking(k: int, score: Callable[[int], Column], names: Sequence[str]) -> Column:
    """Candidate names from best to worst, joined by ' > '; ties in candidate order."""
    ordered = F.array_sort(F.array(*[
        F.struct((-score(i)).alias("s"), F.lit(i).alias("o"), F.lit(names[i]).alias("m")) for i in range(k)
    ]))
    return F.concat_ws(" > ", *[ordered[i]["m"] for i in range(k)])
