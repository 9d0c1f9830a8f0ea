"""Observations from the order tables: for each part, choose one of four supplier pools.

A query is a part, a candidate is a supplier pool, and the outcome is the first line item of the
part served by the pool. The stages below are written once per application and folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemill.functions.candidates import assemble
from choicemill.functions.hashing import query_id
from choicemill.operators import conditioning, splits
from choicemill.params import DEFAULT, Params
from choicemill.sources.stages import written
from choicemill.sources.tables import table

ROW_ORDER = ("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_suppkey", "l_quantity",
             "l_discount", "l_tax")
# The order tables hold parts that a pool never served; incomplete_queries counts what is dropped for it.
FIXTURE = replace(DEFAULT, on_incomplete="drop")
NUMERIC_FEATURES = ("p_size", "p_retailprice", "name_length")


def question() -> Column:
    return F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name", "p_brand")


def with_question(queries: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach the question text where a result shows or measures it."""
    return queries.join(table(spark, sf_dir, "part").select("p_partkey", question().alias("question")), "p_partkey")


def observations(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    """Long table, one row per (query, model)."""
    items = table(spark, sf_dir, "lineitem").select(*ROW_ORDER, "l_partkey", "l_returnflag")
    first = items.groupBy("l_partkey", F.pmod("l_suppkey", F.lit(params.k)).cast("int").alias("ord")).agg(
        F.min(F.struct(*ROW_ORDER, "l_returnflag")).alias("r"))
    parts = table(spark, sf_dir, "part")
    joined = first.join(parts, first["l_partkey"] == parts["p_partkey"])
    names = F.array(*[F.lit(c) for c in params.candidates])
    economy = F.col("p_type").isin("ECONOMY", "PROMO")
    shaped = joined.select(
        "p_partkey", F.when(economy, "d0").otherwise("d1").alias("dataset"), F.col("p_type").alias("category"),
        question().alias("question"),
        names[F.col("ord")].alias("model"), "ord",
        (F.col("r.l_returnflag") != "R").cast("int").alias("correct"),
        F.when(F.col("r.l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("r.l_extendedprice") * (F.lit(1.0) - F.col("r.l_discount"))).alias("raw_cost"),
        F.col("r.l_quantity").alias("latency"),
        F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
        F.length("p_name").cast("double").alias("name_length"))
    return shaped.select(query_id().alias("query_id"), "*")


def stage_observations(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    return written(spark, f"observations|{sf_dir}|{params}", lambda: observations(spark, sf_dir, params))


def stage_queries(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    """Complete queries with their split, one row each; partitioned by split for pruning.

    An incomplete query raises an error unless ``params.on_incomplete`` is "drop".
    """
    if params.on_incomplete not in ("fail", "drop"):
        raise ValueError(f"on_incomplete is fail or drop, not {params.on_incomplete}")

    def build() -> DataFrame:
        # The question text stays out: only ids and numbers travel through the shuffle.
        keys = ["query_id", "dataset", "category", "p_partkey", *NUMERIC_FEATURES]
        nested = assemble(stage_observations(spark, sf_dir, params), keys,
                          ["correct", "raw_cost", "latency"], params.candidates)
        whole = None
        for i in range(params.k):
            present = F.col("cands")[i]["correct"].isNotNull()
            whole = present if whole is None else whole & present
        if params.on_incomplete == "fail" and (lacking := nested.filter(~whole).count()):
            raise ValueError(f"{lacking} queries do not have all {params.k} candidates")
        complete = written(spark, f"complete|{sf_dir}|{params}", lambda: nested.filter(whole))
        return splits.stratified_split(complete, params)

    return written(spark, queries_key(sf_dir, params), build, ["split"])


def incomplete_counts(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    """n_queries, n_complete, n_incomplete: what stage_queries drops or fails on."""
    each = stage_observations(spark, sf_dir, params).groupBy("query_id").agg(F.count("*").alias("n"))
    complete = F.count(F.when(F.col("n") == params.k, 1))
    return each.agg(F.count("*").alias("n_queries"), complete.alias("n_complete"),
                    (F.count("*") - complete).alias("n_incomplete"))


def queries_key(sf_dir: str, params: Params = FIXTURE) -> str:
    return f"queries|{sf_dir}|{params}"


def stage_medians(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    return written(spark, f"medians|{sf_dir}|{params}",
                   lambda: conditioning.train_medians(stage_queries(spark, sf_dir, params), params))


def _cleaned(spark: SparkSession, sf_dir: str, params: Params) -> DataFrame:
    return conditioning.with_clean_costs(stage_queries(spark, sf_dir, params),
                                         stage_medians(spark, sf_dir, params), params)


def stage_cost_range(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    return written(spark, f"range|{sf_dir}|{params}",
                   lambda: conditioning.fit_cost_range(_cleaned(spark, sf_dir, params), params))


def stage_core(spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    """Queries with conditioned costs and utilities: the input of every later operator."""

    def build() -> DataFrame:
        cost = conditioning.read_cost_range(stage_cost_range(spark, sf_dir, params))
        return conditioning.conditioned(_cleaned(spark, sf_dir, params), cost, params)

    return written(spark, f"core|{sf_dir}|{params}", build, ["split"])
