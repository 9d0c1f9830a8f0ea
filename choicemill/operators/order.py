"""Exact order statistics and ranks without sorting a whole group in one task.

A group may hold a third of all rows, so nothing here gives a group to one task. The pattern is
the same throughout: count rows per ordered bucket (partial aggregation, little shuffle), find
the bucket a wanted position falls in, and look only into that bucket. Tables of checked small
size take the built-in ``percentile`` or a window instead; both forms give equal results.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import broadcast_if_small, fits, row_bound, with_row_bound, written

SKETCH_GROUPS = 64  # groups of tasks whose sketches are merged first
HEX_DIGITS = 3  # 4,096 buckets over uniform hex keys


def settled(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder, so that two readers see the same rows."""
    return written(df.sparkSession, f"settled-{uuid.uuid4().hex}", lambda: df)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = part if condition is None else condition & part
    if condition is None:
        raise ValueError("a join needs at least one key")
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


# ---------------------------------------------------------------- ordered buckets

def bucket_count(df: DataFrame, params: Params) -> int:
    """Ordered buckets to use: a power of two, growing with the parallelism of the session."""
    if params.order_buckets:
        return params.order_buckets
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << (min(max(wanted, 64), 4096) - 1).bit_length()


def value_buckets(df: DataFrame, value: str, params: Params = DEFAULT) -> list[float]:
    """Split points of the value, as many as ordered buckets less one.

    They are approximate quantiles of the column itself, so buckets stay balanced whatever the
    distribution; balance within half a bucket is enough, which keeps the sketches of the tasks
    small. Sketches are merged in two levels, so no task takes those of all others. As plain
    numbers (at most 4,095) the points make bucketing a pure function of the value.
    """
    buckets = bucket_count(df, params)
    if buckets < 2:
        return []
    percents = "array(" + ",".join(f"{i / buckets}D" for i in range(1, buckets)) + ")"
    # A sketch of size k is off by some 2.3 / k^0.9 of the rows: half a bucket here.
    k = min(65_535, max(200, math.ceil((4.6 * buckets) ** (1 / 0.9))))
    known = df.select(F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    some = known.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("__g")).agg(
        F.expr(f"kll_sketch_agg_double(__v, {k})").alias("__s"), F.count(F.lit(1)).alias("__n"))
    whole = some.agg(F.expr(f"kll_merge_agg_double(__s, {k})").alias("__s"), F.sum("__n").alias("__n"))
    points = whole.select(F.expr(f"CASE WHEN __n > 0 THEN kll_sketch_get_quantile_double(__s, {percents}) END").alias("s"))
    return points.first()["s"] or []


def with_value_bucket(df: DataFrame, value: str, splits: list[float], name: str = "__bucket") -> DataFrame:
    """Number of split points below the value, found by halving; equal values share a bucket."""
    if not splits:
        return df.withColumn(name, F.lit(0))
    points = F.expr("array(" + ",".join(f"{float(x)!r}D" for x in splits) + ")")
    out = df.withColumn("__p0", F.lit(0))
    half, level = (len(splits) + 1) // 2, 0
    while half >= 1:
        here = F.col(f"__p{level}")
        middle = F.get(points, here + F.lit(half - 1))
        step = F.when(middle < F.col(value), F.lit(half)).otherwise(F.lit(0))
        out = out.withColumn(f"__p{level + 1}", here + step)
        half, level = half // 2, level + 1
    return out.withColumn(name, F.col(f"__p{level}")).drop(*[f"__p{i}" for i in range(level + 1)])


def hex_bucket(key: str) -> Column:
    return F.conv(F.substring(key, 1, HEX_DIGITS), 16, 10).cast("int")


def _cumulate(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows before each bucket. A key has at most as many rows here as there are buckets."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("__before", F.sum("__n").over(running) - F.col("__n"))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
                 params: Params = DEFAULT) -> DataFrame:
    """Values at given 0-based ranks per key: (keys, tag, rank, __value, below).

    ``ranks`` maps a tag to a rank, written over the column ``n`` (rows of the key); ``below`` is
    the number of rows with a smaller value. One counting pass, then one pass over the buckets hit.
    """
    source = df.select(*keys, value).filter(F.col(value).isNotNull())
    bucketed = with_value_bucket(source, value, value_buckets(source, value, params))
    counts = bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    counts = _cumulate(counts, keys, "__bucket").withColumn("n", total)
    wanted = F.array(*[F.struct(F.lit(tag).alias("tag"), rank.cast("long").alias("rank"))
                       for tag, rank in ranks.items()])
    hits = (counts.select(*keys, "__bucket", "__before", "__n", F.inline(wanted))
            .filter("rank >= __before AND rank < __before + __n")
            .select(*keys, "__bucket", "tag", "rank", "__before"))
    hits = settled(hits)
    places = with_row_bound(hits.select(*keys, "__bucket").distinct(), row_bound(hits))
    inside = null_safe_join(bucketed, broadcast_if_small(places, params.broadcast_rows),
                            [*keys, "__bucket"], "left_semi")
    # Equal values collapse before the sort, so a value shared by many rows is a single row here.
    values = inside.groupBy(*keys, "__bucket", value).agg(F.count(F.lit(1)).alias("__c"))
    running = (Window.partitionBy(*keys, "__bucket").orderBy(value)
               .rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("__in", F.sum("__c").over(running) - F.col("__c"))
    found = null_safe_join(values, hits, [*keys, "__bucket"])
    return (found.filter("rank >= __before + __in AND rank < __before + __in + __c")
            .select(*keys, "tag", "rank", F.col(value).alias("__value"),
                    (F.col("__before") + F.col("__in")).alias("below")))


def nth_hex(df: DataFrame, keys: Sequence[str], key: str, wanted: DataFrame,
            params: Params = DEFAULT) -> DataFrame:
    """Hex keys at wanted 0-based ranks: (keys, tag, key).

    ``wanted`` has (keys, tag, rank). The key must be a uniform lower-case hex digest, so its
    leading digits are balanced, order-preserving buckets.
    """
    rows = df.select(*keys, key).withColumn("__bucket", hex_bucket(key))
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    hits = null_safe_join(_cumulate(counts, keys, "__bucket"), wanted, keys)
    hits = settled(hits.filter("rank >= __before AND rank < __before + __n")
                   .select(*keys, "__bucket", "tag", (F.col("rank") - F.col("__before")).alias("__r")))
    places = with_row_bound(hits.select(*keys, "__bucket").distinct(), row_bound(hits))
    inside = null_safe_join(rows, broadcast_if_small(places, params.broadcast_rows),
                            [*keys, "__bucket"], "left_semi")
    numbered = inside.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(key)).cast("long") - 1)
    return null_safe_join(numbered, hits, [*keys, "__bucket", "__r"]).select(*keys, "tag", key)


# ---------------------------------------------------------------- quantiles

def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key as an array column ``q``; exact at any size.

    ``spread`` forces the scale-out form (True) or the built-in one (False); by default the row
    count decides, since ``percentile`` keeps a group's distinct values in one buffer.
    """
    if spread is None:
        spread = not fits(df.select(value), params.small_rows)
    if not spread:
        return df.groupBy(*keys).agg(
            F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    names, rows = (list(keys), df) if keys else (["__all"], df.withColumn("__all", F.lit(0)))
    ranks: dict[str, Column] = {}
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"{i}l"] = F.floor(position)
        ranks[f"{i}u"] = F.ceil(position)
    found = select_ranks(rows, names, value, ranks, params)
    # Keys come from all rows: one without a value has no quantiles, but it is there.
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    sizes = sizes if keys else sizes.withColumn("__all", F.lit(0))
    picked = found.groupBy(*names).agg(*[
        F.max(F.when(F.col("tag") == tag, F.col("__value"))).alias(f"__{tag}") for tag in ranks])
    joined = null_safe_join(sizes, picked, names, "left")
    quantiles = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"__{i}l"), F.col(f"__{i}u")
        quantiles.append(F.when(low == high, low).otherwise(
            (F.ceil(position) - position) * low + (position - F.floor(position)) * high))
    return joined.select(*keys, F.when(F.col("n") > 0, F.array(*quantiles)).alias("q"))


# ---------------------------------------------------------------- tails

def tail_flags(df: DataFrame, keys: Sequence[str], value: str, fraction: float, tie: str = "query_id",
               params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Add ``in_low`` and ``in_high``: membership in the lowest and highest max(1, floor(f n)) rows.

    The order is (value, tie); ``tie`` is a hex digest unique within the key. Rows without a value are in
    neither tail and do not count.
    """
    take = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)).cast("int"))
    if spread is None:
        spread = not fits(df.select(value), params.small_rows)
    if not spread:
        ascending = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value), tie)
        whole = Window.partitionBy(*keys)
        numbered = (df.withColumn("__rn", F.row_number().over(ascending))
                    .withColumn("n", F.count(value).over(whole)))
        known = F.col(value).isNotNull()
        return (numbered.withColumn("in_low", known & (F.col("__rn") <= take))
                .withColumn("in_high", known & (F.col("__rn") > F.col("n") - take)).drop("__rn", "n"))
    cuts = settled(select_ranks(df, keys, value, {"low": take - 1, "high": F.col("n") - take}, params))
    # Rows tied with a cut value are told apart by the tie key, again by buckets.
    tied = null_safe_join(df.select(*keys, value, tie),
                          broadcast_if_small(cuts, params.broadcast_rows), keys)
    tied = tied.filter(F.col(value) == F.col("__value")).select(*keys, "tag", tie)
    wanted = cuts.select(*keys, "tag", (F.col("rank") - F.col("below")).alias("rank"))
    ids = _nth_tied(tied, keys, tie, wanted, params)
    edges = null_safe_join(cuts, ids, [*keys, "tag"]).groupBy(*keys).agg(*[
        F.max(F.when(F.col("tag") == tag, F.col(c))).alias(f"__{tag}_{c}")
        for tag in ("low", "high") for c in ("__value", tie)])
    out = attach(df, settled(edges), keys, tie, "left", params)
    v, t = F.col(value), F.col(tie)
    low = (v < F.col("__low___value")) | ((v == F.col("__low___value")) & (t <= F.col(f"__low_{tie}")))
    high = (v > F.col("__high___value")) | ((v == F.col("__high___value")) & (t >= F.col(f"__high_{tie}")))
    return (out.withColumn("in_low", F.coalesce(low, F.lit(False))).withColumn("in_high", F.coalesce(high, F.lit(False)))
            .drop("__low___value", "__high___value", f"__low_{tie}", f"__high_{tie}"))


def _nth_tied(tied: DataFrame, keys: Sequence[str], tie: str, wanted: DataFrame, params: Params) -> DataFrame:
    """The tie keys at the wanted ranks among the rows of each (keys, cut)."""
    renamed = tied.withColumnRenamed("tag", "__cut")
    targets = wanted.select(*keys, F.col("tag").alias("__cut"), F.lit("id").alias("tag"), "rank")
    found = nth_hex(renamed, [*keys, "__cut"], tie, targets, params)
    return found.select(*keys, F.col("__cut").alias("tag"), tie)


# ---------------------------------------------------------------- ranks

def value_ranks(counts: DataFrame, keys: Sequence[str], value: str, n: str,
                params: Params = DEFAULT) -> DataFrame:
    """Add the average rank ``rank`` (1-based) of each distinct value.

    Input has one row per (keys, value) with its multiplicity ``n``; a value shared by many rows
    is one row, so buckets of distinct values are the only thing that gets sorted. Pass a written
    table: it is read for the split points, the bucket sizes and the ranks.
    """
    bucketed = with_value_bucket(counts, value, value_buckets(counts, value, params))
    sizes = bucketed.groupBy(*keys, "__bucket").agg(F.sum(n).alias("__n"))
    offsets = _cumulate(sizes, keys, "__bucket").drop("__n")
    running = (Window.partitionBy(*keys, "__bucket").orderBy(value)
               .rowsBetween(Window.unboundedPreceding, 0))
    inside = bucketed.withColumn("__in", F.sum(n).over(running) - F.col(n))
    # Same keys as the window, so the wide side is not shuffled again; keys are never NULL here.
    ranked = inside.join(offsets, [*keys, "__bucket"])
    return (ranked.withColumn("rank", F.col("__before") + F.col("__in") + (F.col(n) + 1) / F.lit(2.0))
            .drop("__bucket", "__before", "__in"))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank by window; for tables of checked small size."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    tied = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0))


HOT_SHARE = 1000  # a key with more than 1/1000 of all rows is hot; there are fewer than 1000 of those


def skew_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weights: DataFrame, weight: str,
              salt: Column, how: str = "inner", tasks: int = 0) -> DataFrame:
    """Join rows to a table unique by ``keys``, spreading keys that hold many rows.

    ``weights`` has the number of rows per key. The list of hot keys is small by construction, so
    it is broadcast; hot keys are salted on the row side and replicated on the table side, and all
    others join plainly. A key gets as many salts as its share of all rows is of the ``tasks`` (0: the
    shuffle partitions), so its parts are as large as any other task's. No row is dropped.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = weights.agg(F.sum(weight)).scalar()
    share = F.col(weight) / total
    hot = F.broadcast(weights.filter(F.col(weight) * HOT_SHARE > total).select(
        *keys, F.greatest(F.lit(1), F.ceil(share * tasks)).cast("int").alias("__salts")))
    left = null_safe_join(rows, hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__salts") > 1, F.pmod(F.xxhash64(salt), F.col("__salts")).cast("int")).otherwise(F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    right = null_safe_join(table, hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return null_safe_join(left.drop("__salts"), right, [*keys, "__salt"], how).drop("__salt")


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt: str, how: str = "inner",
           params: Params = DEFAULT) -> DataFrame:
    """Join rows to a parameter table unique by ``keys``: broadcast when its checked size allows,
    else a salted shuffle join."""
    if fits(table, params.broadcast_rows):
        return null_safe_join(rows, F.broadcast(table), keys, how)
    if rows.isStreaming:  # rows cannot be counted ahead of a stream-static join
        return null_safe_join(rows, table, keys, how)
    weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__w"))
    return skew_join(rows, table, keys, weights, "__w", F.col(salt), how)
