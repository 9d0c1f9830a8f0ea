"""Stable ids and hash-derived random draws.

A draw depends only on its key, never on the partition, the order or the attempt of a task, so
results survive repartitioning and lost executors.
"""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The width of a uniform in hex digits, and the uniforms in a digest.
UNIFORM_DIGITS = 13
UNIFORM_LANES = 4


def _poisson_steps() -> tuple[float, ...]:
    """Cumulative probabilities of Poisson(1), as far as a uniform of this width can tell them from 1."""
    size = 2 ** (4 * UNIFORM_DIGITS)
    steps = itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(40))
    return tuple(itertools.takewhile(lambda step: math.ceil(step * size) < size, steps))


POISSON_STEPS = _poisson_steps()


def query_id(dataset: str = "dataset", category: str = "category", question: str = "question") -> Column:
    """First 16 hex digits of the SHA-256 over the identity columns."""
    return F.substring(F.sha2(F.concat_ws("||", dataset, category, question), 256), 1, 16)


def draw_seed(*key: object) -> int:
    """A seed for generators that want a number, from the hash of its key."""
    return int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def lane_digits(digest: str, lane: int) -> Column:
    """The hex digits of one of the four uniforms in a digest."""
    return F.substring(digest, 1 + lane * UNIFORM_DIGITS, UNIFORM_DIGITS)


def poisson_weight(digits: Column) -> Column:
    """Poisson(1) draw by inversion of the uniform with these hex digits.

    Hex digits of one length sort like the numbers they stand for, so the digits are compared with
    the steps as text; nothing is converted per row. Frequent small draws are decided first.
    """
    size = 2 ** (4 * UNIFORM_DIGITS)
    draw = None
    for count, step in enumerate(POISSON_STEPS):
        below = digits < F.lit(f"{math.ceil(step * size):0{UNIFORM_DIGITS}x}")
        draw = F.when(below, count) if draw is None else draw.when(below, count)
    return draw.otherwise(len(POISSON_STEPS))


def poisson_large(digits: Column, mean: Column) -> Column:
    """Poisson draw of a large mean by its normal expansion (second order).

    The uniform's first seven and last six hex digits give a normal by the polar formula.
    """
    first = F.conv(F.substring(digits, 1, 7), 16, 10).cast("double") + 1
    last = F.conv(F.substring(digits, 8, 6), 16, 10).cast("double")
    z = F.sqrt(-2 * F.ln(first / float(1 << 28))) * F.cos(last * (2 * math.pi / (1 << 24)))
    m = mean.cast("double")
    return F.greatest(F.lit(0.0), F.floor(m + F.sqrt(m) * z + (z * z - 1) / 6 + 0.5)).cast("long")


def draw_digest(prefix: str, group: Column, key: str = "query_id") -> Column:
    """Digest that feeds four consecutive draws (group = draw number // 4) of one query."""
    return F.sha2(F.concat(F.lit(prefix + "|"), group.cast("string"), F.lit("|"), F.col(key)), 256)


def draw_weight_array(df: DataFrame, prefix: str, draws: int, name: str, key: str = "query_id") -> DataFrame:
    """Add the Poisson weights of draws 0..draws-1 as one array, equal to those of ``with_draw_weights``."""
    groups = -(-draws // UNIFORM_LANES)
    rows = df.select("*", *[draw_digest(prefix, F.lit(g), key).alias(f"__digest{g}") for g in range(groups)])
    lanes = [(g, lane) for g in range(groups) for lane in range(UNIFORM_LANES)][:draws]
    rows = rows.select(*df.columns, *[lane_digits(f"__digest{g}", lane).alias(f"__draw{g}_{lane}") for g, lane in lanes])
    return rows.select(*df.columns, F.array(*[poisson_weight(F.col(f"__draw{g}_{lane}")) for g, lane in lanes]).alias(name))


def with_draw_weights(df: DataFrame, prefix: str, draws: int, name: str, key: str = "query_id",
                      mean: str | None = None) -> DataFrame:
    """One row per (row, draw number 0..draws-1) with its Poisson weight ``w``; zero weights dropped.

    The digest is taken once per four draws. ``mean`` names a column with the mean of a row's draws: 1, or a large number.
    """
    groups = -(-draws // UNIFORM_LANES)
    rows = df.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rows = rows.withColumn("__digest", draw_digest(prefix, F.col("__group"), key))
    # stack(), not explode() of an array: for the latter the optimizer derives a filter that would
    # repeat the array, and with it the digests.
    lanes = [c for lane in range(UNIFORM_LANES) for c in (F.lit(lane), lane_digits("__digest", lane))]
    rows = rows.select(*df.columns, "__group", F.stack(F.lit(UNIFORM_LANES), *lanes).alias("__lane", "__digits"))
    rows = rows.withColumn(name, F.col("__group") * UNIFORM_LANES + F.col("__lane"))
    weight = poisson_weight(F.col("__digits"))
    if mean:
        weight = F.when(F.col(mean) == 1, weight).otherwise(poisson_large(F.col("__digits"), F.col(mean)))
    rows = rows.withColumn("w", weight)
    return rows.filter((F.col("w") > 0) & (F.col(name) < draws)).drop("__group", "__lane", "__digits")
