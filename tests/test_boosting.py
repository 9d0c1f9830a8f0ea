"""Boosted trees: equal to Spark ML's where nothing is drawn, wherever rows lie, and fitted on the whole grid."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from choicemill import queries
from choicemill.operators import boosting, learners
from choicemill.params import DEFAULT

PLAIN = replace(DEFAULT, boost_rounds=12, boost_patience=12, boost_step=0.1, boost_depth=3, boost_rows=1.0, boost_columns=1.0)


def tables(spark, seed, n=240, targets=2, members=2, even=True):
    """Training and validation rows; the first feature has few values, the third none but 0."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 0], x[:, 2] = rng.integers(0, 4, n), 0.0
    y = np.sin(2 * x[:, [1]]) + (x[:, [0]] > 1) * x[:, [3]] + rng.normal(scale=0.1, size=(n, targets))
    w = np.ones((n, members), int) if even else rng.poisson(1.0, (n, members))
    rows = [(f"q{i}", Vectors.dense(x[i]), [float(v) for v in y[i]], [int(v) for v in w[i]]) for i in range(n)]
    whole = spark.createDataFrame(rows, ["query_id", "features", "y", "w"])
    part = F.substring("query_id", 2, 9).cast("int")
    return whole.filter(part < n * 2 // 3), whole.filter(part >= n * 2 // 3).drop("w"), x


def test_trees_equal_those_of_spark_ml(spark):
    """On the training rows, as cuts between the same two rows of a small node are equally good."""
    from pyspark.ml.regression import GBTRegressor

    train, _, x = tables(spark, 5)
    valid = train.drop("w")
    [found] = boosting.fit_all(train, valid, 5, [boosting.Fit(1, 0, 7)], PLAIN)
    learner = GBTRegressor(labelCol="t", maxIter=12, stepSize=0.1, maxDepth=3, minInstancesPerNode=2, seed=1)
    fitted = learner.fit(train.select("features", F.col("y")[1].alias("t")))
    errors = fitted.evaluateEachIteration(valid.select("features", F.col("y")[1].alias("t")), "squared")
    kept = learners.best_iteration(errors, 12)
    assert len(found.feature) == kept and found.error == pytest.approx(errors[kept - 1], abs=1e-6)
    short = learners.first_rounds(fitted, kept)
    expected = {r["query_id"]: r["prediction"] for r in short.transform(train.select("query_id", "features")).collect()}
    got = boosting.scored(x, found)
    assert [got[int(q[1:])] for q in expected] == pytest.approx(list(expected.values()), abs=1e-6)


def same(a, b):
    return all(np.array_equal(p, q) for p, q in zip(a[:3], b[:3], strict=True)) and a.error == b.error


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_both_forms_grow_the_same_trees(spark, monkeypatch, share):
    """Whole fits in a task, fits over blocks, and other partitions of the same rows."""
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 3)
    params = replace(PLAIN, boost_rounds=7, boost_patience=4, boost_rows=share, boost_columns=share)
    fits = [boosting.Fit(t, m, 10 * t + m) for t in (0, 1) for m in (0, 1)]
    train, valid, _ = tables(spark, 6, even=False)
    whole = boosting.fit_all(train, valid, 5, fits, params)
    other = boosting.fit_all(train.repartition(5), valid.repartition(2), 5, fits, params)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    apart = boosting.fit_all(train.repartition(3, "query_id"), valid.repartition(3), 5, fits, params)
    assert all(same(a, b) and same(a, c) for a, b, c in zip(whole, other, apart, strict=True))
    assert any((f.threshold < np.inf).sum(axis=1).max() > 3 for f in whole)


def test_a_fit_ends_with_its_patience():
    errors = [3.0, 2.0, 1.0, 2.0, 2.0, 0.0]
    for patience in (2, 5):
        state = boosting.Patience(replace(DEFAULT, boost_patience=patience, boost_rounds=6))
        seen = next((i + 1 for i, e in enumerate(errors) if not state.goes_on(e)), len(errors))
        assert state.kept == learners.best_iteration(errors, patience) and seen == min(state.kept + patience, 6)


def test_sums_are_whole_where_a_chunk_does_not_hold_them():
    rng = np.random.default_rng(1)
    layout = boosting.Layout([np.array([0.5, 1.5]), np.array([0.5])], 1.0)
    bins = np.column_stack([rng.integers(0, 3, 300), rng.integers(0, 2, 300)]).astype(np.uint8)
    w, g, slot = rng.integers(1, 9, 300), rng.integers(-(1 << 45), 1 << 45, 300), rng.integers(0, 2, 300)
    found = boosting.histogram(bins, w, g, slot, 2, layout)
    for kind, values in enumerate((w, g)):
        for s in range(2):
            for at, (f, b) in enumerate([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]):
                assert found[kind, s, at] == sum(int(v) for v in values[(slot == s) & (bins[:, f] == b)])


def test_cuts_are_halfway_between_values_at_even_shares(spark):
    values = [[float(i), float(i % 3), 7.0] for i in range(96)]
    rows = spark.createDataFrame([(v,) for v in values], "x array<double>").repartition(3)
    found = boosting.bin_cuts(rows, 3)
    assert list(found[0]) == [3 * i + 2.5 for i in range(31)] and list(found[1]) == [0.5, 1.5] and not len(found[2])


def test_missing_rows_targets_and_models_are_errors(spark, tmp_path):
    train, valid, _ = tables(spark, 7, n=30)
    fits = [boosting.Fit(0, 0, 1)]
    with pytest.raises(ValueError, match="need training and validation"):
        boosting.fit_all(train, valid.limit(0), 5, fits, PLAIN)
    with pytest.raises(ValueError, match="missing"):
        boosting.fit_all(train.withColumn("y", F.array(F.lit(None).cast("double"), F.lit(1.0))), valid, 5, fits, PLAIN)
    with pytest.raises(ValueError, match="have no training query"):
        boosting.fit_all(train.withColumn("w", F.array(F.lit(0), F.lit(1))), valid, 5, fits, PLAIN)
    one = [(0.1, 0, "m0", 0, [0], [0.5], [1.0, 2.0])]
    spark.createDataFrame(one, learners.TREES).write.partitionBy("alpha", "member", "model").parquet(f"{tmp_path}/trees")
    with pytest.raises(ValueError, match="not stored.*model=m1"):
        learners.stored_trees(spark, f"{tmp_path}/trees", (0.1,), (0,))


def test_the_boosted_queries_run_the_whole_grid(spark, monkeypatch):
    """All alphas, members and candidates, with the rounds, patience and step of the parameters."""
    seen = {}

    class Stop(Exception):
        pass

    def fit(vectors, width, path, alphas, members, params=DEFAULT):
        seen.update(alphas=tuple(alphas), members=tuple(members), params=params)
        raise Stop

    monkeypatch.setattr(queries.learned, "stage_vectors", lambda *_: (spark.range(1), [boosting.Fit]))
    monkeypatch.setattr(queries.learned, "width", lambda _: 1)
    monkeypatch.setattr(learners, "fit_boosted", fit)
    with pytest.raises(Stop):
        queries._boosted(spark, "/none/whole-grid")
    assert seen["alphas"] == (0.1, 0.3, 0.5, 0.7, 1.0) and seen["members"] == tuple(range(10))
    p = seen["params"]
    assert (p.boost_rounds, p.boost_patience, p.boost_step, p.boost_depth) == (1000, 50, 0.03, 4)
