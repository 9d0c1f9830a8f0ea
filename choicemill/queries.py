"""Registered queries: key -> callable (spark, folder) -> DataFrame.

Each docstring names the operators of the inventory that the query covers.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicemill.functions.numeric import count_true, rounded
from choicemill.functions.text import normalised
from choicemill.operators import (
    changes,
    comparison,
    conditioning,
    diagnostics,
    ensemble,
    features,
    grading,
    inference,
    learners,
    policies,
    quality,
    rankings,
    reshape,
    routing,
    splits,
)
from choicemill.params import DEFAULT as P
from choicemill.plans import answers, learned, routers, sourcing
from choicemill.session import checkpoint_root
from choicemill.sources import files, questions
from choicemill.sources.stages import stage_path, written
from choicemill.sources.tables import table
from choicemill.streaming import observations as observations_stream
from choicemill.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------ splits, conditioning, utility

@query
def observations(spark, sf):
    """B2: one row per (query, candidate) with its stable id."""
    return sourcing.observations(spark, sf).select(
        "query_id", "dataset", "category", "question", "model", "ord", "correct", "raw_cost", "latency")


@query
def query_splits(spark, sf):
    """Stratified split, ordered."""
    rows = sourcing.with_question(sourcing.stage_queries(spark, sf), spark, sf)
    return splits.ordered_splits(rows.select("query_id", "dataset", "category", "question", "split"))


@query
def query_splits_scaled(spark, sf):
    """The same split by two cut digests per stratum instead of a window."""
    rows = sourcing.stage_queries(spark, sf).select("query_id", "dataset", "category", "p_partkey")
    labelled = splits.stratified_split(rows, P, spread=True)
    return sourcing.with_question(labelled, spark, sf).drop("p_partkey")


@query
def split_counts(spark, sf):
    """E4."""
    return splits.split_counts(sourcing.stage_queries(spark, sf))


@query
def split_stratum_sizes(spark, sf):
    """Floor sizes per stratum."""
    rows = sourcing.stage_queries(spark, sf)
    return rows.groupBy("dataset", "category").agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[count_true(F.col("split") == s).alias(f"n_{s}") for s in splits.SPLITS])


@query
def utility_table(spark, sf):
    """Conditioned costs and utilities, rounded as stored."""
    rows = conditioning.utility_rows(sourcing.stage_core(spark, sf))
    named = [F.col("utilities")[i].alias(f"utility_{i}") for i in range(len(P.alphas))]
    return rows.select("*", *named).drop("utilities")


def _cost_parameters(medians: DataFrame, fitted: DataFrame) -> DataFrame:
    return conditioning.cost_parameters(medians, fitted).select("name", rounded("value", 8).alias("value"))


@query
def cost_parameters(spark, sf):
    """Fitted conditioning parameters."""
    return _cost_parameters(sourcing.stage_medians(spark, sf), sourcing.stage_cost_range(spark, sf))


@query
def cost_parameters_scaled(spark, sf):
    """the same parameters through bucketed order statistics."""
    rows = sourcing.stage_queries(spark, sf)
    medians = conditioning.train_medians(rows, P, spread=True)
    cleaned = conditioning.with_clean_costs(rows, medians, P)
    return _cost_parameters(medians, conditioning.fit_cost_range(cleaned, P, spread=True))


# ------------------------------------------------------------ baselines

@query
def fixed_policies(spark, sf):
    """Every candidate as a fixed policy on test."""
    return policies.fixed_policies(sourcing.stage_core(spark, sf))


@query
def oracle_decisions(spark, sf):
    """Best candidate per query and the regret of each."""
    return policies.oracle_decisions(sourcing.stage_core(spark, sf))


@query
def best_fixed_selection(spark, sf):
    """K3, K4."""
    return policies.best_fixed_selection(sourcing.stage_core(spark, sf)).drop("selected_ord")


@query
def best_fixed_policy(spark, sf):
    """K3."""
    return policies.best_fixed_policy(sourcing.stage_core(spark, sf))


@query
def category_map(spark, sf):
    """K5, K6."""
    return policies.category_map(sourcing.stage_core(spark, sf)).drop("selected_ord")


@query
def fallback_choice(spark, sf):
    """K6."""
    return policies.fallback_choice(sourcing.stage_core(spark, sf)).drop("fallback_ord")


def _category_policy(spark, sf, split):
    core = sourcing.stage_core(spark, sf)
    quality.require_none(quality.empty_splits(core), "splits without a query")
    quality.require_none(quality.label_conflicts(core), "queries under several categories")
    found = policies.category_policy(core, policies.category_map(core), policies.fallback_choice(core), split)
    quality.require_none(quality.selection_problems(found, core, split), "not one selection a query")
    return found


@query
def category_policy_validation(spark, sf):
    """K5-K8, K1, D14."""
    return _category_policy(spark, sf, "validation")


@query
def category_policy_test(spark, sf):
    """K5-K8, K1, D14."""
    return _category_policy(spark, sf, "test")


@query
def baseline_summary(spark, sf):
    """K9: union of the baseline families."""
    core = sourcing.stage_core(spark, sf)
    return policies.fixed_policies(core).unionByName(policies.best_fixed_policy(core), allowMissingColumns=True)


# ------------------------------------------------------------ sources and sinks

@query
def csv_round_trip(spark, sf):
    """Multi-line quoted text through CSV and back, explicit schema, landed as Parquet."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = files.scratch(spark, "csv")
    files.write_csv(docs, path)
    return files.land(files.read_csv(spark, path, docs.schema), files.scratch(spark, "landed"))


@query
def csv_multi_file(spark, sf):
    """A3: several CSV files as one scan."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    paths = []
    for part in range(3):
        paths.append(files.scratch(spark, "csv"))
        files.write_csv(orders.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == part), paths[-1], digits=2)
    rows = files.read_csv(spark, paths, orders.schema)
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query
def question_bank_numeric(spark, sf):
    """A4."""
    items = table(spark, sf, "documents").select(
        F.col("text").alias("question"), "source",
        F.concat("text", F.lit("\n#### step\n####  "), F.col("n_chars").cast("string"), F.lit(" \n")).alias("answer"))
    return questions.numeric_bank(items, "numeric", F.col("source"))


@query
def question_bank_choice(spark, sf):
    """A5."""
    items = table(spark, sf, "part").select(
        F.col("p_name").alias("question"), F.col("p_type").alias("category"),
        F.array("p_brand", "p_type", "p_name", F.col("p_size").cast("string")).alias("choices"),
        (F.col("p_partkey") % 4).cast("int").alias("answer"))
    return questions.choice_bank(items, "letter")


@query
def sample_per_category(spark, sf):
    """The first n rows per group (the sampling feature itself)."""
    items = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return questions.first_rows_per(items, ["p_type"], 20, ["p_partkey"])


@query
def sample_first(spark, sf):
    """The first n rows of a bank (the sampling feature itself)."""
    items = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return questions.first_rows(items, 100, ["p_partkey"])


@query
def report_union(spark, sf):
    """Reports with different columns over the union of columns, 6 decimals."""
    core = sourcing.stage_core(spark, sf)
    frames = [policies.fixed_policies(core), policies.best_fixed_policy(core), policies.fallback_choice(core)]
    return files.for_report(files.union_of_columns(frames).drop("fallback_ord"), digits=6)


@query
def parameter_json(spark, sf):
    """Parameters through JSON and back."""
    path = files.scratch(spark, "json")
    selection = policies.best_fixed_selection(sourcing.stage_core(spark, sf))
    chosen = selection.select("alpha", "selected_model", "validation_mean_utility")
    files.write_json(files.keyed_map(chosen, "alpha"), path)
    return files.read_keyed_map(spark, path, chosen.schema)


@query
def resumable_append(spark, sf):
    """Observations appended in overlapping batches; each key is stored once."""
    rows = sourcing.stage_observations(spark, sf).select("query_id", "model", "correct", "raw_cost", "latency")
    path = files.scratch(spark, "append")
    for batch in (rows.filter(F.col("model") != "m3"), rows, rows):
        files.append_new(spark, batch, path, ["query_id", "model"])
    return files.read_sink(spark, path, rows.schema)


# ------------------------------------------------------------ grading and token costs

@query
def graded_answers(spark, sf):
    """C1-C5."""
    return grading.graded(answers.answers(spark, sf), answers.GRADERS)


@query
def grading_accuracy(spark, sf):
    """C6, B3."""
    rows = grading.graded(answers.answers(spark, sf), answers.GRADERS)
    rows = rows.withColumn("model", normalised(F.concat(F.lit(" "), F.upper("model"), F.lit("\t"))))
    return grading.accuracy(rows, "dataset", "model").withColumn("accuracy", rounded("accuracy", 8))


@query
def token_costs(spark, sf):
    """B1."""
    return grading.token_cost(answers.token_usage(spark, sf), answers.PRICES)


# ------------------------------------------------------------ completeness, integrity, quality

def _expected(spark, sf):
    """Every part is an expected query."""
    economy = F.col("p_type").isin("ECONOMY", "PROMO")
    return table(spark, sf, "part").select(
        F.when(economy, "d0").otherwise("d1").alias("dataset"), "p_partkey")


@query
def duplicate_documents(spark, sf):
    """Questions that occur more than once."""
    return quality.duplicate_texts(answers.document_questions(spark, sf), ["dataset", "category"], "question")


@query
def duplicate_line_keys(spark, sf):
    """D1 on a key that is not unique."""
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def unique_documents(spark, sf):
    """First occurrence of each question."""
    rows = answers.document_questions(spark, sf)
    return splits.unique_queries(rows, ["doc_id"], ["doc_id"])


@query
def candidates_found(spark, sf):
    """D2."""
    return quality.candidates_found(sourcing.stage_observations(spark, sf), ["p_partkey"])


@query
def missing_candidates(spark, sf):
    """D3."""
    return quality.missing_pairs(_expected(spark, sf), sourcing.stage_observations(spark, sf), ["p_partkey"])


@query
def absent_queries(spark, sf):
    """Orders without a line item."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.absent_keys(table(spark, sf, "orders"), rows, ["o_orderkey"])


@query
def completeness_summary(spark, sf):
    """D5."""
    return quality.completeness(_expected(spark, sf), sourcing.stage_observations(spark, sf), ["p_partkey"],
                                "dataset")


@query
def split_violations(spark, sf):
    """D6 on all observations: incomplete queries show up."""
    rows = sourcing.stage_observations(spark, sf).join(
        sourcing.stage_queries(spark, sf).select("query_id", "split"), "query_id", "left")
    return quality.split_violations(rows.withColumn("split", F.coalesce("split", F.lit("none"))))


@query
def incomplete_queries(spark, sf):
    """How many queries every result over splits lacks, as a candidate of theirs is missing."""
    return sourcing.incomplete_counts(spark, sf)


@query
def id_report(spark, sf):
    """D7."""
    return quality.id_report(sourcing.stage_queries(spark, sf))


@query
def side_mismatches(spark, sf):
    """Features of all parts against the queries that have a split."""
    left = sourcing.stage_observations(spark, sf).select("query_id").distinct().withColumn("split", F.lit("train"))
    return quality.side_mismatches(left, sourcing.stage_queries(spark, sf))


@query
def non_finite_features(spark, sf):
    """Logarithms and quotients of line items that are not finite."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", F.try_divide(F.col("l_tax"), F.col("l_discount")).alias("a"),
        F.array(F.col("l_quantity"), F.when(F.col("l_tax") > 0, F.col("l_tax"))).alias("v"))
    return quality.non_finite(rows, "l_orderkey", ["a"], ["v"])


@query
def cost_distribution(spark, sf):
    """D10."""
    return quality.cost_distribution(sourcing.stage_observations(spark, sf))


@query
def cost_distribution_scaled(spark, sf):
    """D10 through bucketed order statistics, over all line items."""
    return quality.cost_distribution(table(spark, sf, "lineitem"), "l_extendedprice", spread=True)


@query
def zero_costs(spark, sf):
    """D11."""
    return quality.zero_costs(sourcing.stage_observations(spark, sf))


@query
def most_expensive(spark, sf):
    """Top-k report."""
    rows = sourcing.stage_observations(spark, sf).select("query_id", "dataset", "model", "raw_cost", "latency")
    return quality.most_expensive(rows, ["query_id", "model"])


@query
def one_to_one(spark, sf):
    """Orders against line items."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.one_to_one(table(spark, sf, "orders"), lines, ["o_orderkey"])


@query
def label_conflicts(spark, sf):
    """Questions (by digest) filed under several categories."""
    rows = answers.document_questions(spark, sf).select(F.sha2("question", 256).alias("digest"), "category")
    return quality.label_conflicts(rows, "digest", "category")


@query
def null_counts(spark, sf):
    """D15."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return quality.null_counts(docs, ["text", "lang", "quality", "toxic"])


@query
def membership(spark, sf):
    """Rows of the validation queries by semi-join."""
    wanted = splits.split_filter(sourcing.stage_queries(spark, sf), "val").select("query_id")
    return sourcing.stage_observations(spark, sf).join(wanted, "query_id", "left_semi").select(
        "query_id", "model", "correct")


# ------------------------------------------------------------ features

@query
def text_features(spark, sf):
    """G1-G10."""
    return features.text_features(answers.document_questions(spark, sf)).drop("question")


@query
def one_hot_features(spark, sf):
    """G11."""
    rows = answers.document_questions(spark, sf).drop("question")
    for label in ("dataset", "category"):
        rows = features.one_hot(rows, label, features.label_values(rows, label))
    return rows


@query
def embedding_features(spark, sf):
    """G12."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    rows = sourcing.stage_queries(spark, sf).select("query_id", (F.col("p_partkey") % n).alias("vec_id"))
    joined = features.with_embedding(rows, vectors, "vec_id")
    return joined.select("query_id", "vec_id", F.posexplode("embedding").alias("dim", "value"))


@query
def feature_table(spark, sf):
    """Feature table of the queries without the category family, checked for leaks."""
    rows = sourcing.with_question(sourcing.stage_queries(spark, sf), spark, sf).select(
        "query_id", "dataset", "category", "split", "question", *sourcing.NUMERIC_FEATURES)
    rows = features.text_features(rows)
    for label in ("dataset", "category"):
        rows = features.one_hot(rows, label, features.label_values(rows, label))
    rows = features.without_prefix(rows, "category_")
    features.manifest(rows)
    return rows.drop("question")


# ------------------------------------------------------------ ensemble and routing

@query
def wide_predictions_to_long(spark, sf):
    """Wide routing state back to one row per candidate."""
    wide = routing.wide_state(routers.both_selections(spark, sf))
    return reshape.long_predictions(wide, ["query_id", "alpha"])


@query
def wide_utilities_to_long(spark, sf):
    """One column per cost weight to one row per cost weight."""
    rows = conditioning.utility_rows(sourcing.stage_core(spark, sf))
    wide = rows.select("query_id", "model", *[F.col("utilities")[i].alias(f"utility_alpha_{a}")
                                              for i, a in enumerate(P.alphas)])
    return reshape.long_utilities(wide, ["query_id", "model"])


@query
def outcomes_wide(spark, sf):
    """One row per query with a column per candidate and metric."""
    rows = sourcing.stage_observations(spark, sf)
    return reshape.wide_candidates(rows, ["query_id"], ["correct", "raw_cost"])


@query
def bootstrap_weights(spark, sf):
    """H3: weights drawn per (member, training query)."""
    rows = ensemble.weighted_training(sourcing.stage_core(spark, sf).select("query_id", "split"))
    return rows.select("query_id", "member", "w")


@query
def training_targets(spark, sf):
    """H1: the feature vector beside the targets, per (query, model, alpha); the vector is shown by its size and norm."""
    vectors, _ = learned.stage_vectors(spark, sf)
    shown = [*sourcing.NUMERIC_FEATURES, "n_features", "feature_norm"]
    # Once a query, before it becomes a row per candidate and cost weight.
    sized = vectors.withColumns({"n_features": F.size("indices"), "feature_norm": rounded(features.l2_norm(F.col("values")), 6)})
    pairs = ensemble.training_pairs(sized, shown)
    return pairs.select("query_id", "alpha", *sourcing.NUMERIC_FEATURES, "model", "target", "n_features", "feature_norm")


def _model(spark, sf, group):
    sums = [rounded(c, 6).alias(c) for i in range(P.k) for c in (f"c{i}", f"n{i}")]
    return routers.stage_model(spark, sf, group).select("member", "grp", "w", *sums)


@query
def group_model(spark, sf):
    """Fitted ensemble by category."""
    return _model(spark, sf, routers.FULL)


@query
def group_model_ablation(spark, sf):
    """Fitted ensemble without the category."""
    return _model(spark, sf, routers.ABLATION)


@query
def member_predictions(spark, sf):
    """Every member's prediction and choice for each validation query."""
    predictions = routers.member_predictions(spark, sf)
    predictions = predictions.withColumn("pick", ensemble.member_choice())
    rows = sourcing.stage_core(spark, sf).filter("split = 'validation'").select(
        "query_id", F.col("category").alias("grp"))
    names = F.array(*[F.lit(m) for m in P.candidates])
    return rows.join(predictions, "grp").select(
        "query_id", "alpha", "member", names[F.col("pick")].alias("selected_model"),
        *[rounded(F.col("yhat")[i], 8).alias(f"predicted_utility_{m}") for i, m in enumerate(P.candidates)])


def _state_rows(state):
    wide = []
    for i, m in enumerate(P.candidates):
        one = F.col("state")[i]
        wide += [one["mean"].alias(f"mean_utility_{m}"), one["risk"].alias(f"risk_{m}"),
                 one["actual"].alias(f"actual_utility_{m}"), F.col("votes")[i].alias(f"vote_fraction_{m}")]
    return state.select("query_id", "category", "alpha", *wide, F.col("disagreement").alias("decision_disagreement"),
                        F.col("entropy").alias("decision_entropy"))


@query
def validation_state(spark, sf):
    """Ensemble statistics of the validation queries."""
    return _state_rows(routers.state(spark, sf, "validation"))


@query
def validation_state_ablation(spark, sf):
    """J12, I1-I6."""
    return _state_rows(routers.state(spark, sf, "validation", routers.ABLATION))


@query
def predictor_errors(spark, sf):
    """H7 for the single fit."""
    return ensemble.predictor_errors(routers.state(spark, sf, "validation", bootstrap=False))


def _no_diagnostics(rows):
    return rows.drop("mean_selected_risk", "mean_decision_disagreement")


@query
def single_fit_router(spark, sf):
    """One full-data fit, no penalty, on validation."""
    rows = routing.with_lambdas(routers.state(spark, sf, "validation", bootstrap=False), [0.0])
    return _no_diagnostics(routing.summarise(routing.decisions(rows), ["alpha"]))


@query
def validation_decisions(spark, sf):
    """Decisions for every (query, alpha, lambda)."""
    rows = routing.with_lambdas(routers.state(spark, sf, "validation"), P.lambdas)
    return routing.decisions(rows).drop("selected_ord", "alpha_id")


@query
def lambda_sweep(spark, sf):
    """J5-J7."""
    return routing.lambda_sweep(routers.state(spark, sf, "validation"))


@query
def lambda_sweep_ablation(spark, sf):
    """J12, J7."""
    return routing.lambda_sweep(routers.state(spark, sf, "validation", routers.ABLATION))


@query
def best_lambdas(spark, sf):
    """J8."""
    return routers.stage_lambdas(spark, sf)


@query
def best_lambdas_ablation(spark, sf):
    """J8, J12."""
    return routers.stage_lambdas(spark, sf, routers.ABLATION)


@query
def frozen_lambdas_json(spark, sf):
    """The chosen penalties through JSON and back."""
    path = files.scratch(spark, "json")
    chosen = routers.stage_lambdas(spark, sf).select("alpha", "lambda", "mean_regret")
    files.write_json(files.keyed_map(chosen, "alpha"), path)
    return files.read_keyed_map(spark, path, chosen.schema)


@query
def test_decisions(spark, sf):
    """J9, J5."""
    return routers.stage_decisions(spark, sf).drop("selected_ord", "alpha_id")


@query
def test_results(spark, sf):
    """J9, J6."""
    return _no_diagnostics(routing.summarise(routers.stage_decisions(spark, sf), ["alpha", "lambda", "router"]))


@query
def test_results_ablation(spark, sf):
    """J12."""
    rows = routers.stage_decisions(spark, sf, routers.ABLATION)
    return _no_diagnostics(routing.summarise(rows, ["alpha", "lambda", "router"]))


@query
def test_state(spark, sf):
    """J10, B7, B16."""
    return routing.wide_state(routers.both_selections(spark, sf))


# ------------------------------------------------------------ risk signals

@query
def routing_records(spark, sf):
    """L5."""
    return diagnostics.routing_records(routers.state(spark, sf, "validation"))


@query
def model_signals(spark, sf):
    """L1-L4."""
    return diagnostics.model_level_signals(routers.state(spark, sf, "validation"))


@query
def model_signals_scaled(spark, sf):
    """L1-L4 through bucketed ranks and cuts."""
    return diagnostics.model_level_signals(routers.state(spark, sf, "validation"), P, spread=True)


@query
def routing_signals(spark, sf):
    """L5-L9."""
    return diagnostics.routing_signals(diagnostics.routing_records(routers.state(spark, sf, "validation")))


@query
def routing_signals_scaled(spark, sf):
    """L5-L9 through bucketed ranks and cuts."""
    records = diagnostics.routing_records(routers.state(spark, sf, "validation"))
    return diagnostics.routing_signals(records, P, spread=True)


@query
def quantity_price_correlation(spark, sf):
    """L1, L2 over all line items: average ranks of tied and untied columns."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return diagnostics.spearman(rows, ["l_returnflag"], "l_quantity", "l_extendedprice", P, spread=True)


# ------------------------------------------------------------ paired inference

def _pairs(spark, sf, group=routers.FULL):
    return inference.pair_decisions(routers.stage_decisions(spark, sf, group))


@query
def router_pairs(spark, sf):
    """M1, B8."""
    return _pairs(spark, sf).drop("alpha_id", "u_selected_ord", "r_selected_ord")


@query
def mcnemar(spark, sf):
    """M4, M5."""
    return inference.discordant(_pairs(spark, sf))


@query
def mean_differences(spark, sf):
    """M2."""
    return inference.mean_differences(_pairs(spark, sf))


@query
def paired_tests(spark, sf):
    """M1-M6 with 10,000 resamples of queries."""
    return inference.paired_tests(_pairs(spark, sf))


@query
def paired_tests_bucketed(spark, sf):
    """M3, M6 with 10,000 resamples of hash buckets: the scale-out form."""
    return inference.paired_tests(_pairs(spark, sf), P, buckets=True)


@query
def mcnemar_segments(spark, sf):
    """M5 on larger counts: late against early line items by status, per return flag."""
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        count_true((F.col("l_linestatus") == "F")).alias("a"),
        count_true((F.col("l_linestatus") == "O")).alias("b"))
    return rows.withColumn("p", rounded(inference.mcnemar_p(F.col("a"), F.col("b"))))


# ------------------------------------------------------------ mechanism, groups, transitions

@query
def changed_decisions(spark, sf):
    """N1, N2, B6, B7, B17."""
    return changes.ordered_details(changes.changed_details(routers.both_selections(spark, sf), P.mechanism_alpha))


@query
def mechanism_summary(spark, sf):
    """N3."""
    return changes.mechanism_summary(changes.changed_details(routers.both_selections(spark, sf), P.mechanism_alpha))


@query
def group_comparison(spark, sf):
    """N4, N5."""
    return changes.group_comparison(_pairs(spark, sf), "d1")


@query
def selection_transitions(spark, sf):
    """N6."""
    return changes.selection_transitions(_pairs(spark, sf))


# ------------------------------------------------------------ prediction and ranking errors

@query
def prediction_errors(spark, sf):
    """One row of predictions a query and alpha, or an error."""
    state = routers.state(spark, sf, "test")
    quality.require_none(quality.duplicate_keys(state, ["query_id", "alpha"]), "predictions that are not one to one")
    return rankings.error_table(state)


def _error_summary(keys, spread=None):
    def run(spark, sf):
        return rankings.error_summary(rankings.error_table(routers.state(spark, sf, "test")), keys, P, spread)
    return run


QUERIES["error_by_model"] = _error_summary(["alpha", "model"])
QUERIES["error_by_category"] = _error_summary(["alpha", "category"])
QUERIES["error_by_model_category"] = _error_summary(["alpha", "category", "model"])
QUERIES["error_by_model_scaled"] = _error_summary(["alpha", "model"], True)


def _ranking(spark, sf):
    return rankings.ranking_rows(routers.state(spark, sf, "test"))


@query
def ranking_errors(spark, sf):
    """O4, O5."""
    return _ranking(spark, sf)


@query
def pairwise_reversals(spark, sf):
    """O6."""
    return rankings.pairwise_reversals(routers.state(spark, sf, "test"))


@query
def ranking_summary(spark, sf):
    """O7."""
    return rankings.ranking_summary(_ranking(spark, sf))


@query
def ranking_by_category(spark, sf):
    """O8."""
    return rankings.ranking_by_category(_ranking(spark, sf))


@query
def ranking_by_margin(spark, sf):
    """O9, O10."""
    return rankings.ranking_by_margin(_ranking(spark, sf))


@query
def ranking_by_margin_scaled(spark, sf):
    """O9, O10 with bucketed quintile edges."""
    return rankings.ranking_by_margin(_ranking(spark, sf), P, spread=True)


# ------------------------------------------------------------ policy comparison

POLICY_METRICS = ("alpha", "policy", "policy_family", "accuracy", "average_cost", "mean_realized_utility", "mean_regret")


@query
def policy_null_counts(spark, sf):
    """Missing values in every column of the policy table; the core metrics must have none."""
    rows = _policies(spark, sf)
    return quality.null_counts(rows, rows.columns)


def _policies(spark, sf):
    rows = written(spark, f"policies|{sf}", lambda: _policy_rows(spark, sf))
    quality.require_none(quality.null_metrics(rows, POLICY_METRICS), "policies without a core metric")
    return rows


def _policy_rows(spark, sf):
    core = sourcing.stage_core(spark, sf)
    fixed, best = policies.fixed_policies(core), policies.best_fixed_policy(core)
    category = policies.category_policy(core, policies.category_map(core), policies.fallback_choice(core), "test")

    def results(group):
        return routing.summarise(routers.stage_decisions(spark, sf, group), ["alpha", "lambda", "router"])

    return comparison.combined([
        comparison.standardised(fixed, F.upper("policy"), "fixed_model", F.element_at(F.split("policy", " "), -1)),
        comparison.standardised(best, F.lit("Best Fixed Utility"), "best_fixed", F.col("validation_selected_model")),
        comparison.standardised(category, F.lit("Category-only"), "category_router"),
        comparison.standardised(results(routers.FULL), comparison.router_policy(F.col("router"), "Full"),
                                "full_ensemble"),
        comparison.standardised(results(routers.ABLATION), comparison.router_policy(F.col("router"), "No-category"),
                                "no_category_ensemble")])


@query
def policy_comparison(spark, sf):
    """P1-P3, B9, B10."""
    return comparison.ordered(comparison.with_pareto_flag(_policies(spark, sf)))


@query
def pareto_rows(spark, sf):
    """P4."""
    return comparison.pareto_rows(comparison.with_pareto_flag(_policies(spark, sf)))


@query
def operating_points(spark, sf):
    """P5."""
    return comparison.operating_points(comparison.pareto_rows(comparison.with_pareto_flag(_policies(spark, sf))))


@query
def supplier_front(spark, sf):
    """P3 over every supplier: kept share against average price of its line items."""
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        rounded(F.avg((F.col("l_returnflag") != "R").cast("double")), 4).alias("accuracy"),
        rounded(F.avg("l_extendedprice"), 2).alias("average_cost"))
    return comparison.with_pareto_flag(rows)


# ------------------------------------------------------------ streaming

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return observations_stream.event_observations(
        observations_stream.read_stream(spark, sf, schema, "events.parquet"))


def _naive(rows):
    """Timestamps without a zone, as in the source tables."""
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c)
                         for c, kind in rows.dtypes])


@query
def stream_ingestion(spark, sf):
    """Q1: the stream arrives twice and is stored once."""
    twice = _event_stream(spark, sf).unionByName(_event_stream(spark, sf))
    return _naive(observations_stream.run_available(observations_stream.ingested(twice, ["event_id"], "1 day")))


@query
def stream_ingestion_restarts(spark, sf):
    """Two runs with separate progress into one sink."""
    path = files.scratch(spark, "sink")
    stream = _event_stream(spark, sf)
    for _ in range(2):
        observations_stream.ingest_across_runs(stream, path, ["event_id"], files.scratch(spark, "progress"))
    return _naive(files.read_sink(spark, path, stream.schema))


@query
def stream_scorecard(spark, sf):
    """Q2, tumbling windows."""
    return _naive(observations_stream.latest_results(
        observations_stream.scorecard(_event_stream(spark, sf), "1 day"), ["window_start", "window_end", "model"]))


@query
def stream_scorecard_sliding(spark, sf):
    """Q2, sliding windows."""
    return _naive(observations_stream.latest_results(
        observations_stream.scorecard(_event_stream(spark, sf), "2 days", "12 hours"), ["window_start", "window_end", "model"]))


@query
def stream_completeness(spark, sf):
    """Q4."""
    return _naive(observations_stream.incomplete(observations_stream.latest_results(
        observations_stream.queries_by_window(_event_stream(spark, sf)), ["window_start", "window_end", "query"])))


@query
def stream_grading(spark, sf):
    """Q3: answers graded and priced as they arrive."""
    schema = table(spark, sf, "lineitem").schema
    items = observations_stream.read_stream(spark, sf, schema, "lineitem.parquet")
    usage = answers.answers_of(items).withColumns({
        "prompt_tokens": F.length("answer").cast("long"), "completion_tokens": F.col("l_orderkey") % 500})
    return observations_stream.run_available(scoring.graded_usage(usage, answers.GRADERS, answers.PRICES))


@query
def stream_decisions(spark, sf):
    """Q3: test queries conditioned and routed with frozen parameters as they arrive."""
    schema = sourcing.stage_queries(spark, sf).schema
    arriving = observations_stream.read_stream(spark, stage_path(spark, sourcing.queries_key(sf)), schema)
    decided = scoring.scored(
        arriving.filter("split = 'test'"), sourcing.stage_medians(spark, sf),
        conditioning.read_cost_range(sourcing.stage_cost_range(spark, sf)), routers.stage_stats(spark, sf),
        {"grp": routers.FULL}, routers.stage_lambdas(spark, sf))
    return observations_stream.run_available(decided).drop("selected_ord", "alpha_id")


# ------------------------------------------------------------ learners on features

@query
def feature_matrix(spark, sf):
    """Every non-zero entry of the learners' feature vectors, with its family."""
    vectors, families = learned.stage_vectors(spark, sf)
    rows = vectors.select("query_id", "split", F.inline(F.arrays_zip(F.col("indices").alias("position"), F.col("values").alias("value"))))
    return rows.select("query_id", "split", learned.family_of(families, F.col("position")).alias("family"), "position", "value")


@query
def label_positions(spark, sf):
    """One-hot positions of a label with any number of values (order keys), joined and not listed."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    positions = features.label_positions(items, "l_orderkey")
    return features.with_label_position(items, "l_orderkey", positions, "position")


@query
def ridge_moments(spark, sf):
    """H2, H4, learner L1: weighted moments of features and targets per member, over their scale."""
    _, families = learned.stage_vectors(spark, sf)
    long = learners.moment_rows(learned.stage_moments(spark, sf), learned.width(families)).filter("value <> 0")
    last = learned.width(families)
    diagonal = F.broadcast(long.filter("i = j").select("member", F.col("i").alias("at"), F.col("value").alias("square")))
    rows = (long.join(diagonal.withColumnsRenamed({"at": "i", "square": "si"}), ["member", "i"])
            .withColumn("k", F.when(F.col("j") <= last, F.col("j")).otherwise(0))
            .join(diagonal.withColumnsRenamed({"at": "k", "square": "sj"}), ["member", "k"]))
    scaled = F.when(F.col("i") == F.col("j"), F.ln("value")).otherwise(F.col("value") / F.sqrt(F.col("si") * F.col("sj")))
    return rows.select("member", "i", "j", rounded(scaled, 6).alias("value"))


@query
def ridge_coefficients(spark, sf):
    """H2-H4, learner L1: coefficients per (member, target), the intercept first."""
    fitted = learned.coefficients(spark, sf)
    rows = [(m, t, [float(v) for v in c[:, t]]) for m, c in fitted.items() if m != learners.PLAIN for t in range(c.shape[1])]
    table_ = spark.createDataFrame(rows, "member int, target int, coefficients array<double>")
    return table_.select("member", "target", F.posexplode("coefficients").alias("feature", "value"))


@query
def ridge_errors(spark, sf):
    """H6, H7, I1-I5, learner L1: validation report of the ridge ensemble, taken inside the queries' rows."""
    return learners.ridge_report(learned.stage_ridge_state(spark, sf).filter("split = 'validation'"))


@query
def ridge_test_results(spark, sf):
    """J6-J9, learner L1: penalty chosen on validation, scored on test."""
    return _no_diagnostics(learned.ridge_test_summary(spark, sf))


@query
def ridge_ablation(spark, sf):
    """J12, B11, learner L1: the same chain without the category family, solved from the stored moments."""
    return _no_diagnostics(learned.ridge_test_summary(spark, sf, "category"))


@query
def ridge_ablation_errors(spark, sf):
    """J12, H7, learner L1: validation errors without each family of features."""
    return learned.ablation_errors(spark, sf)


def _boosted(spark, sf):
    """Fit report and model folder, once per application."""
    path = f"{checkpoint_root(spark)}/models/{spark.sparkContext.applicationId}/{os.path.basename(sf.rstrip('/'))}"
    vectors, families = learned.stage_vectors(spark, sf)
    report = written(spark, f"boosted|{sf}", lambda: learners.fit_boosted(
        vectors, learned.width(families), path, P.alphas, range(P.members), P))
    return report, path


@query
def boosted_fits(spark, sf):
    """H2, H5, A11, learner L2: boosted trees with early stopping, stored per member and candidate."""
    return _boosted(spark, sf)[0]


@query
def boosted_results(spark, sf):
    """H6, A12, I1-I6, J6-J9, learner L2: stored trees scored, penalty chosen on validation, results on test."""
    _, path = _boosted(spark, sf)
    vectors, families = learned.stage_vectors(spark, sf)
    rows = vectors.filter("split <> 'train'")

    def build():
        predictions = learners.predict_boosted(rows, learned.width(families), path, P.alphas, range(P.members), P)
        return ensemble.ensemble_stats(predictions, ["query_id"], P.members)

    stats = written(spark, f"boosted_stats|{sf}", build)
    state = written(spark, f"boosted_state|{sf}",
                    lambda: ensemble.routing_state(rows, stats, {"query_id": "query_id"}), ["split"])
    chosen = routing.best_lambdas(routing.lambda_sweep(state.filter("split = 'validation'")))
    decided = routing.decisions(routing.two_routers(state.filter("split = 'test'"), chosen))
    return _no_diagnostics(routing.summarise(decided, ["alpha", "lambda", "router"]))
