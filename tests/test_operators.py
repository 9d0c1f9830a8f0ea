"""Edge rows and properties of the operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
from decimal import Decimal, InvalidOperation

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from choicemill.functions import hashing, text
from choicemill.functions.candidates import assemble, lengthen
from choicemill.functions.numeric import settled_double
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
    routing,
    splits,
)
from choicemill.params import DEFAULT, Params
from choicemill.plans import answers, learned, routers, sourcing
from choicemill.queries import QUERIES
from choicemill.session import checkpoint_root
from choicemill.sources import files, questions
from choicemill.sources.stages import fits, row_bound, written
from choicemill.streaming import observations as observations_stream
from choicemill.streaming import scoring
from tests.conftest import SF

M = DEFAULT.candidates


# ---------------------------------------------------------------- hashing

def test_query_id_is_the_sha256_prefix(spark):
    row = spark.createDataFrame([("d", "c", "é?")], "dataset string, category string, question string")
    assert row.select(hashing.query_id()).first()[0] == hashlib.sha256("d||c||é?".encode()).hexdigest()[:16]


def test_draws_follow_the_inverse_distribution_and_ignore_partitions(spark):
    ids = spark.createDataFrame([(f"q{i}",) for i in range(300)], "query_id string")
    rows = hashing.with_draw_weights(ids, "7", 10, "member")
    found = {(r["query_id"], r["member"]): r["w"] for r in rows.collect()}
    again = {(r["query_id"], r["member"]): r["w"]
             for r in hashing.with_draw_weights(ids.repartition(7), "7", 10, "member").collect()}
    expected = {}
    for i in range(300):
        for member in range(10):
            digest = hashlib.sha256(f"7|{member // 4}|q{i}".encode()).hexdigest()
            lane = 13 * (member % 4)
            u = int(digest[lane:lane + 13], 16) / 2 ** 52
            weight = sum(u >= step for step in hashing.POISSON_STEPS)
            if weight:
                expected[(f"q{i}", member)] = weight
    assert found == again == expected
    assert abs(sum(found.values()) / 3000 - 1) < 0.1


# ---------------------------------------------------------------- splits

def test_small_strata_and_equal_forms(spark):
    sizes = {"one": 1, "two": 2, "three": 3, "seven": 7, "many": 400}
    rows = [(hashlib.sha256(f"{s}{i}".encode()).hexdigest()[:16], "d", s)
            for s, n in sizes.items() for i in range(n)]
    queries = spark.createDataFrame(rows, "query_id string, dataset string, category string")
    labels = []
    for spread in (False, True):
        out = splits.stratified_split(queries.repartition(5), DEFAULT, spread)
        labels.append({r["query_id"]: r["split"] for r in out.collect()})
        counts = {(r["category"], r["split"]): r["count"] for r in out.groupBy("category", "split").count().collect()}
        for s, n in sizes.items():
            train, validation = int(n * 0.70), int(n * 0.15)
            assert counts.get((s, "train"), 0) == train
            assert counts.get((s, "validation"), 0) == validation
            assert counts.get((s, "test"), 0) == n - train - validation
    assert labels[0] == labels[1] and len(labels[0]) == len(rows)


def test_first_occurrence_wins(spark):
    rows = spark.createDataFrame([("d", "c", "q", 3, "late"), ("d", "c", "q", 1, "first"), ("d", "e", "q", 2, "x")],
                                 "dataset string, category string, question string, pos int, gt string")
    out = {r["category"]: (r["gt"], r["copies"]) for r in splits.unique_queries(rows, ["pos"], ["gt"]).collect()}
    assert out == {"c": ("first", 2), "e": ("x", 1)}


# ---------------------------------------------------------------- conditioning and policies

def nested(spark, rows):
    """rows: (query, split, category, [(correct, cost) per candidate])."""
    long = [(f"{q:0>16}", "d", c, s, m, ok, float(cost), 1.0)
            for q, s, c, outcomes in rows for m, (ok, cost) in zip(M, outcomes, strict=True)]
    df = spark.createDataFrame(long, "query_id string, dataset string, category string, split string, model string,"
                                     " correct int, raw_cost double, latency double")
    return assemble(df, ["query_id", "dataset", "category", "split"], ["correct", "raw_cost", "latency"], M)


def core_of(spark, rows):
    queries = nested(spark, rows)
    medians = conditioning.train_medians(queries)
    cleaned = conditioning.with_clean_costs(queries, medians)
    cost = conditioning.read_cost_range(conditioning.fit_cost_range(cleaned))
    return conditioning.conditioned(cleaned, cost)


def test_equal_costs_give_zero_normalised_cost(spark):
    core = core_of(spark, [("1", "train", "a", [(1, 2.0)] * 4), ("2", "test", "a", [(0, 9.0)] * 4)])
    long = lengthen(core).collect()
    assert {r["normalized_cost"] for r in long} == {0.0}
    assert {r["cost_winsorized"] for r in long if r["query_id"].endswith("2")} == {1}


def test_zero_cost_takes_the_training_median(spark):
    core = core_of(spark, [("1", "train", "a", [(1, 2.0)] * 4), ("2", "train", "a", [(1, 4.0)] * 4),
                           ("3", "test", "a", [(1, 0.0)] * 4)])
    rows = [r for r in lengthen(core).collect() if r["query_id"].endswith("3")]
    assert {(r["cost_imputed"], r["cost_clean"]) for r in rows} == {(1, 3.0)}


def test_missing_median_fails(spark):
    queries = nested(spark, [("1", "train", "a", [(1, 0.0)] + [(1, 2.0)] * 3)])
    cleaned = conditioning.with_clean_costs(queries, conditioning.train_medians(queries))
    with pytest.raises(PySparkException, match="no training median"):
        cleaned.collect()


def test_ties_go_to_the_first_candidate_and_category_ties_to_the_first_name(spark):
    core = core_of(spark, [(str(i), s, "a", [(1, 5.0)] * 4) for i, s in enumerate(["train", "validation", "test"])])
    assert {r["oracle_model"] for r in policies.oracle_decisions(core).collect()} == {M[0]}
    assert {r["selected_model"] for r in policies.best_fixed_selection(core).collect()} == {M[0]}
    swapped = Params(candidates=("z", "y", "x", "w"))
    best = policies.best_mean(swapped, alphabetical=True)
    means = spark.range(1).select(F.array(*[F.lit(1.0)] * 4).alias("means"))
    assert means.select(best["model"]).first()[0] == "w"
    assert means.select(policies.best_mean(swapped)["model"]).first()[0] == "z"


def test_unseen_category_takes_the_fallback(spark):
    core = core_of(spark, [("1", "train", "a", [(0, 5.0), (1, 5.0), (0, 5.0), (0, 6.0)]),
                           ("2", "test", "new", [(1, 5.0)] * 4)])
    mapping, fallback = policies.category_map(core), policies.fallback_choice(core)
    chosen = policies.category_choices(core, mapping, fallback, "test").select("pick.model").distinct().collect()
    assert [r[0] for r in chosen] == [M[1]]


def test_results_do_not_depend_on_partitions(spark):
    core = sourcing.stage_core(spark, SF)
    plain = policies.fixed_policies(core).toPandas().sort_values(["alpha", "policy"])
    moved = policies.fixed_policies(core.repartition(13)).toPandas().sort_values(["alpha", "policy"])
    assert plain.reset_index(drop=True).equals(moved.reset_index(drop=True))


# ---------------------------------------------------------------- ensemble and routing

def test_group_without_weight_takes_the_member_mean(spark):
    model = spark.createDataFrame(
        [(0, "a", 2, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, "b", 2, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
        "member int, grp string, w long, c0 double, n0 double, c1 double, n1 double, c2 double, n2 double,"
        " c3 double, n3 double")
    groups = spark.createDataFrame([("a",), ("unseen",)], "grp string")
    out = ensemble.predict_groups(model, groups, 1).filter("alpha_id = 0").collect()
    assert {r["grp"]: r["yhat"][0] for r in out} == {"a": 1.0, "unseen": 0.5}
    assert {r["member"] for r in ensemble.missing_members(model).collect()} == set(range(1, 10))


def test_routing_properties(spark):
    state = routers.state(spark, SF, "test")
    rows = routing.decisions(routing.with_lambdas(state, DEFAULT.lambdas))
    assert rows.filter("regret < 0").count() == 0
    zero = rows.filter("lambda = 0").select("query_id", "alpha", "selected_model")
    only = diagnostics.routing_records(state).select("query_id", "alpha", "selected_model")
    assert zero.exceptAll(only).count() == 0
    votes = state.select(F.aggregate("votes", F.lit(0.0), lambda a, b: a + b).alias("v"))
    assert votes.filter("abs(v - 1) > 1e-9").count() == 0
    assert state.filter("disagreement < 0 or disagreement > 1 or entropy < 0 or entropy > 1").count() == 0


def test_smaller_penalty_wins_a_tie(spark):
    sweep = spark.createDataFrame([(0.1, 2.0, 0.5), (0.1, 0.5, 0.5), (0.1, 0.0, 0.6)],
                                  "alpha double, lambda double, mean_regret double")
    assert routing.best_lambdas(sweep).first()["lambda"] == 0.5


def by_numpy(x, y, w, mean, spread, kept):
    """Weighted ridge on scaled features, penalty 1 and a free intercept; coefficients for features as they are."""
    design = np.column_stack([np.ones(len(x)), (x - mean) / spread])[:, kept]
    shrink = np.diag([0.0] + [1.0] * (len(kept) - 1))
    found = np.zeros((x.shape[1] + 1, y.shape[1]))
    found[kept] = np.linalg.solve((design * w[:, None]).T @ design + shrink, (design * w[:, None]).T @ y)
    out = found.copy()
    out[1:] = found[1:] / spread[:, None]
    out[0] = found[0] - (found[1:] * (mean / spread)[:, None]).sum(axis=0)
    return out


@pytest.fixture(scope="module")
def training(spark):
    """Features, targets and member weights of the training queries, and the families."""
    vectors, families = learned.stage_vectors(spark, SF)
    train = vectors.filter("split = 'train'")
    rows = train.orderBy("query_id").collect()
    x = np.zeros((len(rows), learned.width(families)))
    for i, r in enumerate(rows):
        x[i, r["indices"]] = r["values"]
    y = np.array([[c["correct"] for c in r["cands"]] + [c["normalized_cost"] for c in r["cands"]] for r in rows], dtype=float)
    place = {r["query_id"]: i for i, r in enumerate(rows)}
    w = np.zeros((len(rows), 10))
    for r in ensemble.weighted_training(train.select("query_id", "split")).collect():
        w[place[r["query_id"]], r["member"]] = r["w"]
    return x, y, w, families


@pytest.mark.parametrize("family", ["", "category", "embedding", "numeric"])
def test_ridge_and_its_ablation_equal_numpy(spark, training, family):
    x, y, w, families = training
    fitted = learned.coefficients(spark, SF, family)
    gone = [i + 1 for f in families if f.name == family for i in range(f.start, f.stop)]
    kept = [i for i in range(x.shape[1] + 1) if i not in gone]
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread <= 1e-9 * np.sqrt((x * x).mean(axis=0)) + 1e-300] = 1.0
    for member, weights in [(learners.PLAIN, np.ones(len(x))), (0, w[:, 0]), (7, w[:, 7])]:
        expected = by_numpy(x, y, weights, mean, spread, kept)
        design = np.column_stack([np.ones(len(x)), x])
        assert np.allclose(design @ fitted[member], design @ expected, atol=1e-7)
        assert not fitted[member][gone].any()


def test_features_are_checked_once(spark, monkeypatch):
    calls = []
    check = learned.side_mismatches
    monkeypatch.setattr(learned, "side_mismatches", lambda *a: calls.append(1) or check(*a))
    for family in ("", "category"):
        learned.coefficients(spark, SF, family)
    assert len(calls) <= 1


def test_weights_in_an_array_equal_weights_in_rows(spark):
    core = sourcing.stage_core(spark, SF).select("query_id", "split")
    rows = {(r["query_id"], r["member"]): r["w"] for r in ensemble.weighted_training(core).collect()}
    for r in hashing.draw_weight_array(core.filter("split = 'train'"), "42", 10, "w").collect():
        for m, w in enumerate(r["w"]):
            assert rows.get((r["query_id"], m), 0) == w


def test_statistics_inside_the_row_equal_those_of_the_aggregate(spark):
    """Ties among predictions go to the first candidate in both."""
    rng = random.Random(5)
    core = sourcing.stage_core(spark, SF).filter("split = 'validation'").orderBy("query_id").limit(40)
    ids = [r["query_id"] for r in core.collect()]
    values = {q: [([rng.choice([0.2, 0.5, 0.7]) for _ in range(4)], [rng.choice([0.0, 0.1, 0.3]) for _ in range(4)]) for _ in range(10)] for q in ids}
    kind = "query_id string, predictions array<struct<correct:array<double>,cost:array<double>>>"
    rows = core.join(spark.createDataFrame(list(values.items()), kind), "query_id")
    got = ensemble.state_from_predictions(rows, "predictions", 10)
    long = [(q, i, a, m, [c - a * n for c, n in zip(*p, strict=True)])
            for q, each in values.items() for i, a in enumerate(DEFAULT.alphas) for m, p in enumerate(each)]
    stats = ensemble.ensemble_stats(spark.createDataFrame(
        long, "query_id string, alpha_id int, alpha double, member int, yhat array<double>").select(
            "query_id", "alpha_id", "alpha", "member", F.transform("yhat", settled_double).alias("yhat")), ["query_id"], 10)
    expected = ensemble.routing_state(core, stats, {"query_id": "query_id"})
    order = ["query_id", "alpha_id"]
    columns = got.columns
    for a, b in zip(got.orderBy(*order).collect(), expected.select(*columns).orderBy(*order).collect(), strict=True):
        for name in ("votes", "disagreement", "entropy", "oracle_model"):
            assert a[name] == b[name]
        for x, y in zip(a["state"], b["state"], strict=True):
            assert (x["mean"], x["actual"], x["model"]) == (y["mean"], y["actual"], y["model"])
            assert x["risk"] == pytest.approx(y["risk"], abs=2e-8)


def test_scoring_shuffles_nothing(spark):
    vectors, _ = learned.stage_vectors(spark, SF)
    fitted = {m: c for m, c in learned.coefficients(spark, SF).items() if m != learners.PLAIN}
    rows = ensemble.state_from_predictions(learners.with_predictions(vectors, fitted), "predictions", 10)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_five_thousand_labels(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("label"), F.col("id") % 5_003)).alias("label"))
    made, families = features.feature_vectors(rows.withColumn("x", F.col("id") / 2), {"numeric": ["x"]}, ["label"], None, 0)
    labels = sorted({f"label{i % 5_003}" for i in range(20_000) if i % 7})
    assert [(f.name, f.start, f.size) for f in families] == [("numeric", 0, 1), ("label", 1, len(labels))]
    place = {v: i + 1 for i, v in enumerate(labels)}
    for r in made.collect():
        hot = [place[r["label"]]] if r["label"] else []
        assert r["indices"] == ([0] if r["id"] else []) + hot
        assert r["values"] == ([r["id"] / 2] if r["id"] else []) + [1.0] * len(hot)


def test_vectors_refuse_leaks_and_bad_numbers(spark):
    rows = spark.createDataFrame([("q", 1.0, float("nan"))], "query_id string, correct double, x double")
    with pytest.raises(ValueError, match="outcome"):
        features.feature_vectors(rows, {"numeric": ["correct"]}, [], None, 0)
    for bad in (float("nan"), float("inf"), None):
        rows = spark.createDataFrame([("q", bad), ("r", 1.0)], "query_id string, x double")
        made, _ = features.feature_vectors(rows, {"numeric": ["x"]}, [], None, 0)
        with pytest.raises(ValueError, match="not finite"):
            features.require_finite(made)


def test_a_cut_ensemble_equals_a_shorter_fit(spark):
    from pyspark.ml.regression import GBTRegressor

    vectors, families = learned.stage_vectors(spark, SF)
    rows = learners.with_vector(vectors, learned.width(families)).select("features", F.col("cands")[0]["correct"].cast("double").alias("y"))
    learner = GBTRegressor(featuresCol="features", labelCol="y", maxIter=4, maxDepth=2, seed=3)
    short = learners.first_rounds(learner.fit(rows), 2)
    again = learner.setMaxIter(2).fit(rows)
    assert len(short.trees) == 2 and short.treeWeights == again.treeWeights
    both = again.setPredictionCol("b").transform(short.setPredictionCol("a").transform(rows))
    assert both.filter("abs(a - b) > 1e-12").count() == 0


def test_boosted_inputs_hold_a_query_once_in_blocks(spark, monkeypatch):
    """Targets and weights sit in the query's row; partitions follow the number of queries."""
    monkeypatch.setattr(learners, "FIT_ROWS", 40)
    vectors, families = learned.stage_vectors(spark, SF)
    core = vectors.filter("split = 'train'")
    train, valid = learners.boosted_inputs(vectors, learned.width(families), (0.5, 0.1), (0, 1))
    assert train.count() == core.count() and valid.count() == vectors.filter("split = 'validation'").count()
    assert train.rdd.getNumPartitions() == -(-vectors.count() // 40)
    pairs = ensemble.training_pairs(vectors, []).join(ensemble.weighted_training(core.select("query_id", "split")), "query_id")
    for at, (alpha, member, model) in [(1, (0.5, 1, "m1")), (6, (0.1, 0, "m2"))]:
        expected = pairs.filter((F.col("alpha") == alpha) & (F.col("member") == member) & (F.col("model") == model))
        found = train.select(F.col("y")[at], F.col("w")[member]).filter(F.col(f"w[{member}]") > 0)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select("target", "w").collect()))


def test_norms_are_taken_once_a_vector(spark):
    """Not for every element of an embedding, and not for every row of a query."""
    given = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [None, 2.0]), (3, None)]
    vectors = spark.createDataFrame(given, "vec_id int, embedding array<float>")
    joined = features.with_embedding(spark.range(5).select(F.col("id").cast("int").alias("at")), vectors, "at")
    assert {r["at"]: r["embedding"] for r in joined.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [None, 2.0], 3: None, 4: None}

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString().splitlines()

    assert sum(line.count("aggregate(") for line in plan(joined)) == 1
    lines = plan(QUERIES["training_targets"](spark, SF))
    norms = [i for i, line in enumerate(lines) if "aggregate(" in line]
    assert len(norms) == 1 and norms[0] > max(i for i, line in enumerate(lines) if "Generate" in line)


def test_a_query_that_comes_twice_is_weighted_as_by_a_join(spark):
    vectors, families = learned.stage_vectors(spark, SF)
    twice = vectors.unionByName(vectors.filter("split = 'train'").limit(7))
    train, _ = learners.boosted_inputs(twice, learned.width(families), (0.5,), (0,))
    joined = twice.filter("split = 'train'").select("query_id").join(
        ensemble.weighted_training(twice.select("query_id", "split")).filter("member = 0"), "query_id")
    assert train.filter("w[0] > 0").count() == joined.count()


def test_patience():
    assert learners.best_iteration([3, 2, 1, 2, 2, 0], 2) == 3
    assert learners.best_iteration([3, 2, 1, 2, 2, 0], 5) == 6
    assert learners.best_iteration([1, 2, 3], 1) == 1


# ---------------------------------------------------------------- diagnostics and inference

def records(spark, values):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest()[:16], 0.1, float(r), float(v), float(v), float(v))
            for i, (v, r) in enumerate(values)]
    return spark.createDataFrame(rows, "query_id string, alpha double, regret double, selected_risk double,"
                                       " disagreement double, entropy double")


@pytest.mark.parametrize("spread", [False, True])
def test_auroc_by_brute_force(spark, spread):
    rng = random.Random(3)
    values = [(rng.randint(0, 4) / 10, rng.choice([0.0, 0.07, 0.2])) for _ in range(60)]
    out = diagnostics.routing_signals(records(spark, values), DEFAULT, spread).collect()
    for row in out:
        t = row["failure_threshold"]
        pos, neg = [v for v, r in values if r > t], [v for v, r in values if r <= t]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert row["auroc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-8)


def test_auroc_needs_both_classes(spark):
    out = diagnostics.routing_signals(records(spark, [(0.1, 0.0), (0.2, 0.0)])).collect()
    assert {r["auroc"] for r in out} == {None}


def exact_p(a, b):
    n, k = a + b, min(a, b)
    if a == b:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)


def test_mcnemar(spark):
    cases = [(0, 0), (1, 0), (0, 5), (3, 3), (2, 9), (40, 61), (300, 260), (30_000, 30_400), (60_000, 60_500),
             (500_000, 501_200)]
    df = spark.createDataFrame(cases, "a long, b long")
    for row in df.select("a", "b", inference.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect():
        a, b = row["a"], row["b"]
        if a + b <= 2000:
            assert row["p"] == pytest.approx(exact_p(a, b), rel=1e-10)
        else:
            n, k = a + b, min(a, b)
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
                    for i in range(max(0, k - 20_000), k + 1)]
            assert row["p"] == pytest.approx(min(1.0, 2 * math.fsum(math.exp(x) for x in logs)), rel=1e-6)


def test_intervals_by_brute_force(spark):
    params = Params(resamples=40)
    rng = random.Random(5)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest()[:16], 0, 0.1, rng.randint(0, 1), rng.randint(0, 1),
             rng.random(), rng.random(), rng.random(), rng.random()) for i in range(50)]
    pairs = spark.createDataFrame(rows, "query_id string, alpha_id int, alpha double, u_correct int, r_correct int,"
                                        " u_realized_utility double, r_realized_utility double, u_regret double,"
                                        " r_regret double")
    out = inference.bootstrap_intervals(pairs, params).filter("alpha = 0.1").first()
    means = []
    for b in range(40):
        total = weight = 0
        for row in rows:
            digest = hashlib.sha256(f"ci42|{b // 4}|{row[0]}".encode()).hexdigest()
            u = int(digest[13 * (b % 4):13 * (b % 4) + 13], 16) / 2 ** 52
            w = sum(u >= step for step in hashing.POISSON_STEPS)
            total, weight = total + w * (row[6] - row[5]), weight + w
        means.append(total / weight)
    assert out["utility_ci_lower"] == pytest.approx(np.quantile(means, 0.025), abs=1e-7)
    assert out["utility_ci_upper"] == pytest.approx(np.quantile(means, 0.975), abs=1e-7)
    near = inference.bootstrap_intervals(pairs, Params(resamples=400), buckets=True).filter("alpha = 0.1").first()
    assert near["utility_ci_lower"] < np.mean([r[6] - r[5] for r in rows]) < near["utility_ci_upper"]


def test_equal_differences_are_drawn_one_by_one(spark):
    """Every query has weights of its own, however many others have the same differences."""
    kind = ("query_id string, alpha_id int, alpha double, u_correct int, r_correct int, u_realized_utility double,"
            " r_realized_utility double, u_regret double, r_regret double")
    rows = [(f"{i:016x}", 0, 0.1, 1, int(i % 10 > 0), 0.5, 0.5 - 0.1 * (i % 10 == 0), 0.0, 0.1 * (i % 10 == 0)) for i in range(4_000)]
    units = inference.resampling_units(spark.createDataFrame(rows, kind), Params(resamples=10))
    assert units.count() == 4_000
    drawn = hashing.with_draw_weights(units, "ci42", 10, "b", "unit").groupBy("b").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("accuracy_0")).alias("accuracy"))
    found = inference.resampled_sums(units, "ci42", 10).select("b", F.col("n_0").cast("long"), "accuracy_0")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, drawn.collect()))


@pytest.mark.parametrize("mean", [33, 400, 10_000_000])
def test_large_poisson_draws(spark, mean):
    draws = hashing.with_draw_weights(spark.createDataFrame([("u", mean)], "unit string, mean long"), "x", 40_000, "b", "unit", "mean")
    found = draws.agg(F.avg("w"), F.var_samp("w"), F.count("*")).first()
    assert found[0] == pytest.approx(mean, abs=5 * math.sqrt(mean / 40_000)) and found[1] == pytest.approx(mean, rel=0.05)
    assert found[2] == 40_000


def test_router_names(spark):
    names = ["Risk-Aware", "risk utility", "utility_only", "policy lambda=0", " LAMBDA_0 ", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(inference.router_key(F.col("n"))).collect()] == [
        "risk_aware", "risk_aware", "utility_only", "utility_only", "utility_only", None]


def test_only_queries_with_both_routers_are_paired(spark):
    decisions = routers.stage_decisions(spark, SF)
    first = decisions.agg(F.min("query_id")).first()[0]
    part = decisions.filter((F.col("query_id") != first) | (F.col("router") == "utility_only"))
    assert inference.pair_decisions(part).filter(F.col("query_id") == first).count() == 0


# ---------------------------------------------------------------- changes, rankings, comparison

def test_no_changed_decision_gives_null_rates(spark):
    pairs = routers.both_selections(spark, SF).filter("u.ord = r.ord")
    row = changes.mechanism_summary(changes.changed_details(pairs, 0.5)).first()
    assert row["changed_decisions"] == 0 and row["lower_risk_selected_rate"] is None
    assert row["wrong_to_correct"] == 0


@pytest.mark.parametrize("spread", [False, True])
def test_equal_margins_share_one_bin(spark, spread):
    rows = rankings.ranking_rows(routers.state(spark, SF, "test")).withColumn("predicted_margin", F.lit(0.25))
    bins = rankings.with_margin_bin(rows, DEFAULT, spread).select("margin_bin").distinct().collect()
    assert [r[0] for r in bins] == [1]


@pytest.mark.parametrize("seed", range(4))
def test_pareto_by_brute_force(spark, seed):
    rng = random.Random(seed)
    params = Params(order_buckets=8)
    points = [(i, round(rng.random(), 1) + rng.choice([0, 5e-7, 2e-6]), round(rng.random(), 1) + rng.choice([0, 5e-11, 2e-10]))
              for i in range(120)]
    points += [(1000 + i, a, c) for i, (_, a, c) in enumerate(points[:20])]
    ta, tc = params.accuracy_tolerance, params.cost_tolerance

    def dominated(p):
        return any(q[1] >= p[1] - ta and q[2] <= p[2] + tc and (q[1] > p[1] + ta or q[2] < p[2] - tc) for q in points)

    df = spark.createDataFrame(points, "id int, accuracy double, average_cost double")
    flags = {r["id"]: r["accuracy_cost_pareto"] for r in comparison.with_pareto_flag(df, params=params).collect()}
    assert flags == {p[0]: not dominated(p) for p in points}


def test_standardised_names(spark):
    df = spark.createDataFrame([(0.1, 0.9, 2.0, 0.5, 0.1, "x")],
                               "alpha double, acc double, cost double, utility double, regret double, lambda string")
    row = comparison.standardised(df, F.lit("p"), "best_fixed").first()
    assert (row["accuracy"], row["average_cost"], row["num_queries"], row["lambda"]) == (0.9, 2.0, None, None)
    with pytest.raises(ValueError, match="none of"):
        comparison.standardised(df.drop("acc"), F.lit("p"), "best_fixed")


# ---------------------------------------------------------------- grading and text

ANSWERS = ["Final Answer: 12", "x 5\nfinal answer:  1,234.50 done", "about -7 or 8", "", "Final Answer:\n\n42", "none",
           "Final Answer: twelve 3 4", "Final Answer:", "+1,000", "Final Answer: 5\n6", "12,", " B\n", "final answer: c)",
           "Final Answer: Cat", "(A) b", "Final Answer: D.", "d", "FINAL ANSWER: a",
           "Final Answer:\u00a0B", "\u00a0b\u2003", "Final Answer:\u2003 7 \u0085", "\x1c c\u2028", "Final Answer: d\u3000"]


def python_numeric(answer):
    found = re.search(r"(?i)Final Answer:\s*([^\n]*)", answer)
    body = (found.group(1) if found else answer).strip()
    number = re.search(r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?", body)
    return number.group(0).replace(",", "") if number else body


def python_equal(prediction, truth):
    try:
        return int(Decimal(prediction) == Decimal(truth.replace(",", "").strip()))
    except InvalidOperation:
        return int(prediction.strip().lower() == truth.strip().lower())


def test_numeric_grading_against_python(spark):
    truths = ["12", "1,234.5", "none", "42.0", "TWELVE 3 4", "-7"]
    rows = [("numeric", a, t) for a in ANSWERS for t in truths]
    df = spark.createDataFrame(rows, "dataset string, answer string, ground_truth string")
    for r in grading.graded(df, {"numeric": "numeric"}).collect():
        assert r["prediction"] == python_numeric(r["answer"]), r
        assert r["correct"] == python_equal(r["prediction"], r["ground_truth"]), r


def test_letter_grading_and_unknown_dataset(spark):
    def letter(answer):
        found = re.search(r"(?i)Final Answer:\s*([ABCD])\b", answer)
        alone = answer.strip().upper()
        return found.group(1).upper() if found else (alone if alone in {"A", "B", "C", "D"} else "")

    df = spark.createDataFrame([("letter", a, " c ") for a in ANSWERS], "dataset string, answer string, ground_truth string")
    for r in grading.graded(df, {"letter": "letter"}).collect():
        assert r["prediction"] == letter(r["answer"])
        assert r["correct"] == int(r["prediction"] == "C")
    with pytest.raises(PySparkException, match="no grader"):
        grading.graded(df, {"numeric": "numeric"}).collect()


def largest_method(df):
    """Bytes of the largest method that Spark generates for a plan; the JVM compiles none above 8,000."""
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


def test_grading_is_compiled_with_several_datasets_of_a_grader(spark):
    graders = {"numeric": "numeric", "letter": "letter", "sums": "numeric", "choices": "letter"}
    usage = answers.answers(spark, SF).withColumns({"prompt_tokens": F.length("answer"), "completion_tokens": F.lit(1)})
    assert largest_method(scoring.graded_usage(usage, graders, answers.PRICES)) < 7_500
    rows = [("sums", "12", "12.0", 1), ("sums", "\u0661\u0662", "12", 1), ("sums", "none", " NONE\n", 1), ("sums", None, "1", None),
            ("sums", "x", None, None), ("choices", " b\u2003", "B", 1), ("choices", None, "", 1), ("choices", "ab", "A", 0)]
    df = spark.createDataFrame(rows, "dataset string, answer string, ground_truth string, wanted int")
    for r in grading.graded(df, graders).collect():
        assert r["correct"] == r["wanted"], r


TEXTS = ["Don't stop - it's 3,5 or -2.5!\r\nA. x\nB. y\nC. z\nD. w\n", "", "naïve café’s Ωmega?? x=y^2%", "one\n\n\ntwo\r\n",
         "...!?!", "tab\tend\r", "-a- 'b' c_d", "日本語 テキスト。"]


def test_text_features_against_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "question string")
    for r in features.text_features(df).collect():
        t = r["question"]
        words = re.findall(r"\b[\w'-]+\b", t)
        assert r["char_count"] == len(t) and r["word_count"] == len(words), t
        assert r["line_count"] == max(1, len(t.splitlines())), t
        assert r["sentence_count"] == max(1, len(re.findall(r"[.!?]+", t)))
        assert r["number_count"] == len(re.findall(r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?", t))
        assert r["math_symbol_count"] == sum(c in "+-*/=<>^%$" for c in t)
        assert r["question_mark_count"] == t.count("?")
        assert r["option_count"] == len(re.findall(r"(?m)^[ABCD]\.\s", t))
        assert r["avg_word_length"] == pytest.approx(sum(map(len, words)) / len(words) if words else 0, abs=1e-6)


def test_feature_guards(spark):
    df = spark.createDataFrame([("q", 1)], "query_id string, correct int")
    with pytest.raises(ValueError, match="outcome"):
        features.manifest(df)
    with pytest.raises(ValueError, match="no column"):
        features.without_prefix(df, "category_")
    assert text.column_name(" High-school  Physics! ") == "high_school_physics"


def test_zero_vector_keeps_its_length(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(features.unit_length(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


# ---------------------------------------------------------------- sources and quality

def test_csv_with_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text('dataset,category,question,ground_truth\nd,c,"line 1\nline ""2"", end",7\nd,c,plain,\n')
    rows = files.read_csv(spark, [str(path), str(path)], files.QUESTION_BANK).collect()
    assert len(rows) == 4 and rows[0]["question"] == 'line 1\nline "2", end'


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 4), (2, "b", 6)], "q int, model string, v int")
    for _ in range(2):
        files.append_new(spark, rows, str(tmp_path / "sink"), ["q", "model"])
    stored = files.read_sink(spark, str(tmp_path / "sink"), rows.schema).collect()
    assert sorted((r["q"], r["v"]) for r in stored) == [(1, 4), (2, 6)]


def test_an_append_keeps_the_first_arrival_and_reads_its_partitions_only(spark, tmp_path):
    path = tmp_path / "sink"
    rows = spark.createDataFrame([(i, 10 - t, t) for i in range(200) for t in (2, 1)], "q int, v int, ts int")
    files.append_new(spark, rows, str(path), ["q"], ["ts"], buckets=16)
    stored = files.read_sink(spark, str(path), rows.schema)
    assert {(r["v"], r["ts"]) for r in stored.collect()} == {(9, 1)} and stored.count() == 200
    one = spark.createDataFrame([(7, 0, 0), (1_000, 0, 0)], rows.schema)
    mine = {r[0] for r in one.select(F.pmod(F.xxhash64("q"), F.lit(16))).collect()}
    for part in path.glob(f"{files.BUCKET}=*"):
        if int(part.name.split("=")[1]) not in mine:
            for file in part.glob("*.parquet"):
                file.write_bytes(b"a batch that touches other partitions must not read this")
            for crc in part.glob(".*.crc"):
                crc.unlink()
    files.append_new(spark, one, str(path), ["q"], ["ts"], buckets=16)
    assert files.read_sink(spark, str(path), rows.schema, sorted(mine)).filter("q = 1000").count() == 1


def test_ten_restarts_store_one_row_a_key(spark, tmp_path):
    source, path, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    schema = "ts timestamp, query long, model string, correct int, cost double, event_id long, tokens long"
    for run in range(10):
        made = spark.range(40).select(
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3_600).alias("ts"), (F.col("id") % 5).alias("query"),
            F.concat(F.lit("m"), F.col("id") % 2).alias("model"), F.lit(1).alias("correct"), F.lit(1.0 * run).alias("cost"),
            (F.col("id") + 100 * run).alias("event_id"), F.lit(0).cast("long").alias("tokens"))
        made.coalesce(1).write.mode("append").parquet(str(source))
        stream = observations_stream.scorecard(spark.readStream.schema(schema).parquet(str(source)), "1 day", delay="30 days")
        got = observations_stream.latest_results(stream, ["window_start", "window_end", "model"], path, progress)
    rows = got.collect()
    assert sum(r["n"] for r in rows) == 400 and len({(r["window_start"], r["model"]) for r in rows}) == len(rows)
    assert spark.read.parquet(str(tmp_path / "out" / "*")).count() == len(rows)
    assert [p.name.split("=")[0] for p in (tmp_path / "out").iterdir()] == ["base"]


def test_bank_normalisers(spark):
    items = spark.createDataFrame([("q", "1+1 #### x\n#### 2 \n")], "question string, answer string")
    assert questions.numeric_bank(items, "n", "m").first()["ground_truth"] == "2"
    with pytest.raises(ValueError, match="requested"):
        questions.first_rows(items, 2, ["question"])


def test_guards_find_planted_violations(spark):
    kind = "query_id string, split string, category string, cands array<struct<correct:int>>"
    full = [(1,)] * 4
    rows = [("a", "train", "x", full), ("b", "test", "x", full), ("c", "validation", "y", full)]
    good = spark.createDataFrame(rows, kind)
    assert quality.side_mismatches(good, good, "cands").count() == 0
    bad = spark.createDataFrame([("a", "test", "x", full), ("b", "test", "x", full[:3]), ("d", "train", "x", full)], kind)
    assert {(r["query_id"], r["reason"]) for r in quality.side_mismatches(good, bad, "cands").collect()} == {
        ("a", "split_differs"), ("b", "candidates"), ("c", "only_left"), ("d", "only_right")}
    assert quality.empty_splits(good).count() == 0
    assert [r["split"] for r in quality.empty_splits(bad).collect()] == ["validation"]
    summary = spark.createDataFrame([(0.1, 1), (0.3, 2)], "alpha double, n_queries long")
    assert [r["alpha"] for r in quality.selection_problems(summary, good, "test").collect()] == [0.3]
    assert quality.selection_problems(summary, good, "other").count() == 2
    assert quality.label_conflicts(good).count() == 0
    assert quality.label_conflicts(good.union(spark.createDataFrame([("a", "train", "z", full)], kind))).count() == 1
    policies_ = spark.createDataFrame([(0.1, None, 1.0), (0.1, "p", None)], "alpha double, policy string, accuracy double")
    assert {r["column"] for r in quality.null_metrics(policies_, ["alpha", "policy", "accuracy"]).collect()} == {"policy", "accuracy"}
    twice = good.union(good)
    with pytest.raises(ValueError, match="one to one"):
        quality.require_none(quality.duplicate_keys(twice, ["query_id"]), "one to one")


def test_quality_checks(spark):
    rows = spark.createDataFrame([("1", "train", "m0"), ("1", "test", "m1"), ("2", "test", "m0")],
                                 "query_id string, split string, model string")
    assert {r["query_id"] for r in quality.split_violations(rows).collect()} == {"1", "2"}
    with pytest.raises(ValueError, match="broken"):
        quality.require_none(quality.split_violations(rows), "broken")
    quality.require_none(rows.limit(0), "fine")
    bad = spark.createDataFrame([("a", float("nan"), [1.0]), ("b", 1.0, [float("inf")]), ("c", 1.0, [1.0])],
                                "k string, x double, v array<double>")
    assert {r[0] for r in quality.non_finite(bad, "k", ["x"], ["v"]).collect()} == {"a", "b"}
    sides = quality.side_mismatches(rows.limit(1).select("query_id", "split"),
                                    spark.createDataFrame([("9", "test")], "query_id string, split string"))
    assert {r["reason"] for r in sides.collect()} == {"only_left", "only_right"}


# ---------------------------------------------------------------- session

class _Cluster:
    """A session that is not local and names no shared folder."""

    class conf:
        @staticmethod
        def get(_key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="shared folder"):
        checkpoint_root(_Cluster())
    assert checkpoint_root(spark)


def test_stage_sizes_are_recorded(spark):
    df = written(spark, "sized", lambda: spark.range(7))
    assert row_bound(df) == 7 and df.count() == 7
    assert fits(df, 7) and not fits(df, 6)


def test_incomplete_queries_fail_unless_dropped_by_name(spark):
    sf = "/root/testdata/sf0.01"
    counts = QUERIES["incomplete_queries"](spark, sf).first()
    assert counts.n_incomplete > 0 and counts.n_queries == counts.n_complete + counts.n_incomplete
    with pytest.raises(ValueError, match=f"{counts.n_incomplete} queries"):
        sourcing.stage_queries(spark, sf, Params())
    with pytest.raises(ValueError, match="on_incomplete"):
        sourcing.stage_queries(spark, sf, Params(on_incomplete="other"))
    assert sourcing.stage_queries(spark, sf).count() == counts.n_complete
    print("incomplete", counts)
