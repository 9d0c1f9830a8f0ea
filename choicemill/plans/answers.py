"""Answer tables by expression over line items and documents, for grading and token costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemill.functions.text import LETTERS
from choicemill.operators.features import text_features
from choicemill.params import DEFAULT as P
from choicemill.sources.tables import table

GRADERS = {"numeric": "numeric", "letter": "letter"}
# Price per million prompt and completion tokens, one pair per candidate.
PRICES = {"m0": (0.15, 0.60), "m1": (3.0, 15.0), "m2": (0.10, 0.40), "m3": (0.05, 0.25)}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_of(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"))


def answers_of(items: DataFrame) -> DataFrame:
    """Two graded questions per line item: its quantity, and the letter of its supplier pool."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    form = F.col("l_orderkey") % 6
    number = (F.when(form == 0, F.concat(F.lit("Let me see.\nFinal Answer: "), quantity))
              .when(form == 1, F.concat(F.lit("final answer: "), quantity, F.lit(".00 units")))
              .when(form == 2, F.concat(F.lit("about "), quantity, F.lit(" or 7")))
              .when(form == 3, F.concat(F.lit("Final Answer: 1,"), F.lpad(quantity, 3, "0")))
              .when(form == 4, F.lit("Final Answer: unknown")).otherwise(F.lit("")))
    letter = F.get(F.array(*[F.lit(x) for x in LETTERS]), (F.col("l_suppkey") % 4).cast("int"))
    choice = (F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Final Answer: "), F.col("l_returnflag")))
              .otherwise(F.concat(F.lit(" "), F.lower(letter), F.lit("\n"))))
    pool = F.concat(F.lit("m"), (F.col("l_suppkey") % P.k).cast("string"))
    both = F.array(
        F.struct(F.lit("numeric").alias("dataset"), number.alias("answer"), quantity.alias("ground_truth")),
        F.struct(F.lit("letter").alias("dataset"), choice.alias("answer"), letter.alias("ground_truth")))
    return items.select("l_orderkey", "l_linenumber", pool.alias("model"), F.inline(both))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_features(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "text")
    return docs.select(
        "doc_id", F.concat(F.lit("m"), (F.col("doc_id") % P.k).cast("string")).alias("model"),
        F.col("approx_token_count").cast("long").alias("prompt_tokens"),
        (F.col("n_chars") % 500).alias("completion_tokens"))


def document_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("dataset"), F.col("source").alias("category"),
        F.col("text").alias("question"))
