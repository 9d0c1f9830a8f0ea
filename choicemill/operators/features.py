"""Query features: text structure, one-hot labels and embeddings; nothing from the outcome."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemill.functions.text import column_name, structural_features, words_marked
from choicemill.operators.quality import non_finite, require_none
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import broadcast_if_small, row_bound, written

# Columns that identify a query, and columns that would leak the outcome.
ID_COLUMNS = ("query_id", "dataset", "category", "split", "question")
OUTCOME_COLUMNS = ("ground_truth", "answer", "prediction", "correct", "cost", "raw_cost", "cost_clean",
                   "latency", "prompt_tokens", "completion_tokens", "total_tokens", "utility")


def text_features(rows: DataFrame, text: str = "question") -> DataFrame:
    staged = rows.withColumn("__marked", words_marked(text))
    columns = structural_features(text, "__marked")
    return staged.select(*rows.columns, *[value.alias(name) for name, value in columns.items()])


def label_values(rows: DataFrame, label: str, limit: int = 1000) -> list[str]:
    """Sorted distinct labels, for one-hot columns; more than ``limit`` labels is an error.

    One column per label only makes sense for few labels; index-based encoders serve the rest.
    """
    found = [row[0] for row in rows.select(label).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} values of {label}: encode by index instead")
    return sorted(found)


def one_hot(rows: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    return rows.select("*", *[
        (F.col(label) == v).cast("int").alias(f"{label}_{column_name(v)}") for v in values])


def label_positions(rows: DataFrame, label: str) -> DataFrame:
    """label, position: every distinct label with its place in sorted order, from 0.

    Any number of labels: they are sorted by ranges, and a place is the place within the range plus what
    the ranges before hold. NULL is no label.
    """
    spark = rows.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    labels = rows.select(F.col(label).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    ranged = written(spark, f"labels-{uuid.uuid4().hex}", lambda: labels.repartitionByRange("label").sortWithinPartitions("label")
                     .select("label", F.spark_partition_id().alias("__range"), within.alias("__within")))
    # One row a range: as many as the sort had partitions.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = ranged.join(F.broadcast(starts), "__range").select(
        "label", (F.col("__before") + F.col("__within")).cast("int").alias("position"))
    return written(spark, f"positions-{uuid.uuid4().hex}", lambda: placed)


def with_label_position(rows: DataFrame, label: str, positions: DataFrame, name: str, params: Params = DEFAULT) -> DataFrame:
    """Attach a label's position; NULL labels and labels without a position get NULL."""
    known = broadcast_if_small(positions, params.broadcast_rows)
    return rows.join(known.select(F.col("label").alias("__of"), F.col("position").alias(name)),
                     F.col(label).cast("string") == F.col("__of"), "left").drop("__of")


@dataclass(frozen=True)
class Family:
    """A family of features: its index range in the vector is start .. start + size - 1."""

    name: str
    start: int
    size: int

    @property
    def stop(self) -> int:
        return self.start + self.size


def feature_vectors(rows: DataFrame, columns: dict[str, Sequence[str]], labels: Sequence[str], embedding: str | None,
                    dimensions: int, params: Params = DEFAULT) -> tuple[DataFrame, list[Family]]:
    """``rows`` with one sparse feature vector (``indices``, ``values``) each, and the manifest of its families.

    ``columns`` are numeric columns by family; each label becomes a family with one index per distinct value,
    known from a table and never listed on the driver; the embedding array comes last. Zeros are left out.
    Outcome columns among the features, and missing or non-finite numbers, are errors.
    """
    named = [c for family in columns.values() for c in family]
    leaks = [c for c in [*named, *labels, *([embedding] if embedding else [])] if c in OUTCOME_COLUMNS or c.startswith("utility")]
    if leaks:
        raise ValueError(f"outcome columns among the features: {leaks}")
    families: list[Family] = []
    parts: list[Column] = []

    def entry(at: Column, value: Column) -> Column:
        return F.struct(at.cast("int").alias("i"), value.cast("double").alias("v"))

    for name, family in columns.items():
        families.append(Family(name, families[-1].stop if families else 0, len(family)))
        parts.append(F.array(*[entry(F.lit(families[-1].start + j), F.col(c)) for j, c in enumerate(family)]))
    others = rows.columns
    empty = F.array().cast("array<struct<i:int,v:double>>")
    for label in labels:
        positions = label_positions(rows, label)
        families.append(Family(label, families[-1].stop if families else 0, row_bound(positions)))
        rows = with_label_position(rows, label, positions, f"__at_{label}", params)
        at = F.col(f"__at_{label}")
        parts.append(F.when(at.isNotNull(), F.array(entry(F.lit(families[-1].start) + at, F.lit(1.0)))).otherwise(empty))
    if embedding:
        start = families[-1].stop if families else 0
        families.append(Family("embedding", start, dimensions))
        parts.append(F.coalesce(F.transform(embedding, lambda x, j: entry(F.lit(start) + j, x)), empty))
    entries = F.filter(F.concat(*parts), lambda e: e["v"].isNull() | (e["v"] != 0))
    made = rows.select(*others, entries.alias("__e")).select(
        *others, F.col("__e.i").alias("indices"), F.col("__e.v").alias("values"))
    return made, families


def require_finite(vectors: DataFrame, key: str = "query_id") -> DataFrame:
    """The same rows; a NaN, infinite or missing feature is an error."""
    require_none(non_finite(vectors, key, [], ["values"]), "features that are missing or not finite")
    return vectors


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit_length(vector: Column, digits: int = 8, norm: Column | None = None) -> Column:
    """Vector scaled to L2 norm 1 and rounded; a zero vector stays as it is.

    ``norm`` names a column with the vector's norm; without it the norm is taken again for every element.
    """
    norm = l2_norm(vector) if norm is None else norm

    def scaled(x: Column) -> Column:
        x = x.cast("double")
        return F.round(F.when(norm > 0, x / norm).otherwise(x), digits)

    return F.transform(vector, scaled)


def with_embedding(rows: DataFrame, embeddings: DataFrame, left: str, right: str = "vec_id",
                   vector: str = "embedding") -> DataFrame:
    """Attach given embeddings as one array column of unit length."""
    normed = embeddings.select(F.col(right).alias(left), F.col(vector), l2_norm(F.col(vector)).alias("__norm"))
    unit = normed.select(left, unit_length(F.col(vector), norm=F.col("__norm")).alias("embedding"))
    return rows.join(unit, left, "left")


def without_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """Drop the columns of a feature family; an error when there are none."""
    kept = [c for c in rows.columns if not c.startswith(prefix)]
    if len(kept) == len(rows.columns):
        raise ValueError(f"no column starts with {prefix}")
    return rows.select(*kept)


def manifest(rows: DataFrame) -> list[tuple[str, str]]:
    """(feature, family) of every feature column; outcome columns are an error."""
    leaks = [c for c in rows.columns if c in OUTCOME_COLUMNS or c.startswith("utility")]
    if leaks:
        raise ValueError(f"outcome columns among the features: {leaks}")

    def family(name: str) -> str:
        for prefix in ("dataset_", "category_", "embedding"):
            if name.startswith(prefix):
                return prefix.rstrip("_")
        return "structural"

    return [(c, family(c)) for c in rows.columns if c not in ID_COLUMNS]
