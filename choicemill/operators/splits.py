"""Unique queries and the seeded, stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemill.functions.hashing import query_id
from choicemill.operators.order import attach, nth_hex, settled
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import fits

STRATUM = ("dataset", "category")
# The split labels in output order.
SPLITS = ("train", "validation", "test")


def identity_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the identity columns: a short key in place of whole texts."""
    return F.sha2(F.concat_ws("\0", *columns), 256)


def unique_queries(rows: DataFrame, order: Sequence[str], payload: Sequence[str],
                   identity: Sequence[str] = ("dataset", "category", "question")) -> DataFrame:
    """One row per identity: the payload of its first row in a given total order.

    Rows group by a digest, so texts travel once, as payload, and are never sort keys. Partial
    aggregation keeps one row per key and task before the shuffle: a key with very many copies
    costs no more than any other.
    """
    first = F.min_by(F.struct(*identity, *payload), F.struct(*order)).alias("first")
    unique = rows.groupBy(identity_digest(identity).alias("__d")).agg(first, F.count(F.lit(1)).alias("copies"))
    flat = unique.select("first.*", "copies")
    return flat.select(query_id(*identity).alias("query_id"), *flat.columns)


def split_key(seed: int) -> Column:
    """Digest that orders the queries of a stratum at random but repeatably."""
    return F.sha2(F.concat_ws("||", F.lit(str(seed)), "query_id"), 256)


def _sizes(n: Column, params: Params) -> tuple[Column, Column]:
    """Rows in train, and in train and validation together."""
    train = F.floor(n * F.lit(params.train_ratio)).cast("long")
    validation = F.floor(n * F.lit(params.validation_ratio)).cast("long")
    return train, train + validation


def stratified_split(queries: DataFrame, params: Params = DEFAULT, spread: bool | None = None) -> DataFrame:
    """Add ``split``: floor(0.70 n) train, floor(0.15 n) validation, the rest test, per stratum.

    Small tables number the rows of a stratum by window. Otherwise each stratum is cut at two
    digests, found from bucket counts and the two buckets that hold the cuts; labelling then is a
    comparison per row, and neither a whole stratum nor the table itself is shuffled.
    """
    keyed = queries.withColumn("__key", split_key(params.seed))
    if spread is None:
        spread = not fits(queries, params.small_rows)
    if not spread:
        number = F.row_number().over(Window.partitionBy(*STRATUM).orderBy("__key"))
        n = F.count(F.lit(1)).over(Window.partitionBy(*STRATUM))
        counted = keyed.withColumn("__rn", number).withColumn("__n", n)
        train, both = _sizes(F.col("__n"), params)
        label = (F.when(F.col("__rn") <= train, SPLITS[0])
                 .when(F.col("__rn") <= both, SPLITS[1]).otherwise(SPLITS[2]))
        return counted.withColumn("split", label).drop("__key", "__rn", "__n")

    sizes = keyed.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("n"))
    train, both = _sizes(F.col("n"), params)
    wanted = sizes.select(*STRATUM, F.inline(F.array(
        F.struct(F.lit("train").alias("tag"), (train - 1).alias("rank")),
        F.struct(F.lit("both").alias("tag"), (both - 1).alias("rank"))))).filter("rank >= 0")
    cuts = nth_hex(keyed, list(STRATUM), "__key", wanted, params)
    cuts = settled(cuts.groupBy(*STRATUM).agg(*[
        F.max(F.when(F.col("tag") == tag, F.col("__key"))).alias(f"__{tag}") for tag in ("train", "both")]))
    joined = attach(keyed, cuts, list(STRATUM), "query_id", "left", params)
    # A stratum without a cut has no rows on that side: '' sorts before every digest.
    label = (F.when(F.col("__key") <= F.coalesce("__train", F.lit("")), SPLITS[0])
             .when(F.col("__key") <= F.coalesce("__both", F.lit("")), SPLITS[1]).otherwise(SPLITS[2]))
    return joined.withColumn("split", label).drop("__key", "__train", "__both")


def split_order(column: str = "split") -> Column:
    order = F.when(F.col(column) == SPLITS[0], 0).when(F.col(column) == SPLITS[1], 1)
    return order.otherwise(2)


def ordered_splits(queries: DataFrame) -> DataFrame:
    """Rows by split, dataset, category and id. A range-partitioned sort."""
    return queries.orderBy(split_order(), "dataset", "category", "query_id")


def split_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("split").agg(F.count(F.lit(1)).alias("n_queries"))


def split_filter(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of one split; 'val' is accepted as another name of 'validation'."""
    names = ("validation", "val") if split in ("validation", "val") else (split,)
    return df.filter(F.col(column).isin(*names))
