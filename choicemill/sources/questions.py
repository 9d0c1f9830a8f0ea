"""Question banks: raw items to (dataset, category, question, ground_truth)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicemill.functions.text import final_answer, letter_of, lettered_question


def numeric_bank(items: DataFrame, dataset: str, category: str | Column, question: str = "question",
                 answer: str = "answer") -> DataFrame:
    """Ground truth is the text after the last separator of the worked answer."""
    label = F.lit(category) if isinstance(category, str) else category
    return items.select(F.lit(dataset).alias("dataset"), label.alias("category"),
                        F.col(question).alias("question"), final_answer(answer).alias("ground_truth"))


def choice_bank(items: DataFrame, dataset: str, category: str = "category", stem: str = "question",
                choices: str = "choices", answer: str = "answer") -> DataFrame:
    """Stem and four lettered choices; the answer index becomes its letter."""
    return items.select(F.lit(dataset).alias("dataset"), F.col(category).alias("category"),
                        lettered_question(stem, choices).alias("question"),
                        letter_of(answer).alias("ground_truth"))


def first_rows(items: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in a total order; asking for more than there are is an error."""
    if n > items.count():
        raise ValueError(f"{n} rows requested, fewer available")
    return items.orderBy(*order).limit(n)


def first_rows_per(items: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """At most n rows per group. Spark limits each group before the shuffle, so a large group
    sends n rows per task."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("__rn", number).filter(F.col("__rn") <= n).drop("__rn")
