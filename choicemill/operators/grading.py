"""Answers to outcomes, token costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicemill.functions import text


def graded(answers: DataFrame, graders: dict[str, str], kind: str = "dataset", answer: str = "answer",
           truth: str = "ground_truth") -> DataFrame:
    """Add ``prediction`` and ``correct``; ``graders`` maps a dataset to 'numeric' or 'letter'.

    A dataset without a grader fails the job.
    """
    def of(grader: str) -> Column:
        return F.col(kind).isin(*[dataset for dataset, g in graders.items() if g == grader])

    def pick(**values: Column) -> Column:
        unknown = F.raise_error(F.concat(F.lit("no grader for "), F.coalesce(F.col(kind), F.lit("NULL"))))
        branches = None
        for grader in dict.fromkeys(graders.values()):
            hit = of(grader)
            branches = F.when(hit, values[grader]) if branches is None else branches.when(hit, values[grader])
        return branches.otherwise(unknown)

    # Each pattern runs once per answer: what several expressions need is a column of its own. A grader is written out
    # once for all its datasets: all steps are one method, which the JVM compiles only below a size.
    rows = answers.withColumn("__body", F.when(of("numeric"), text.answer_body(answer)))
    rows = rows.withColumn("__number", text.first_number("__body"))
    rows = rows.withColumn("prediction", pick(numeric=text.numeric_prediction("__body", "__number"),
                                              letter=text.letter_prediction(answer)))
    rows = rows.withColumn("correct", pick(numeric=text.numeric_correct("prediction", truth),
                                           letter=text.letter_correct("prediction", truth)).cast("int"))
    return rows.drop("__body", "__number")


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))


def token_cost(rows: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``cost`` from prompt and completion tokens and a price list per million tokens.

    The list has one entry per candidate, so it becomes a CASE in the projection; an unknown
    candidate gets NULL.
    """
    def price(side: int) -> Column:
        branches = None
        for model, pair in prices.items():
            hit, value = F.col("model") == model, F.lit(float(pair[side]))
            branches = F.when(hit, value) if branches is None else branches.when(hit, value)
        return branches

    million = F.lit(1_000_000.0)
    cost = F.col("prompt_tokens") / million * price(0) + F.col("completion_tokens") / million * price(1)
    return rows.withColumn("cost", F.round(cost, 8))
