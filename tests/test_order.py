"""Order statistics: scale-out forms equal the plain ones, also with hot values and NULL keys."""

from __future__ import annotations

import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from choicemill.operators import order
from choicemill.operators.diagnostics import spearman
from choicemill.params import DEFAULT, Params

P = Params(order_buckets=16)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and one key; one key is NULL; one group has one row."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = 5.0 if rng.random() < 0.34 else round(rng.gauss(5, 3), 2)
        rows.append((key, value, round(rng.random(), 1), hashlib.sha256(str(i).encode()).hexdigest()[:16]))
    rows.append(("single", 1.5, 0.5, "0" * 16))
    return spark.createDataFrame(rows, "g string, v double, y double, query_id string").cache()


def rows_of(df, *names):
    return sorted(((tuple(r[n] for n in names)) for r in df.collect()), key=str)


def test_quantiles(skewed):
    probs = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    plain = {r["g"]: r["q"] for r in order.exact_quantiles(skewed, ["g"], "v", probs, P, False).collect()}
    spread = {r["g"]: r["q"] for r in order.exact_quantiles(skewed, ["g"], "v", probs, P, True).collect()}
    assert plain.keys() == spread.keys()
    for key, values in plain.items():
        assert values == pytest.approx(spread[key], abs=1e-12)


def test_quantiles_without_key(skewed):
    expected = skewed.toPandas()["v"].quantile(0.37)
    found = order.exact_quantiles(skewed, [], "v", [0.37], P, True).first()["q"][0]
    assert found == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("value", ["v", "y"])
def test_tails(skewed, value):
    known = skewed.filter("g is not null")
    names = ("g", "query_id", "in_low", "in_high")
    plain = order.tail_flags(known, ["g"], value, 0.2, "query_id", P, False)
    spread = order.tail_flags(known, ["g"], value, 0.2, "query_id", P, True)
    assert rows_of(plain, *names) == rows_of(spread, *names)
    one = [r for r in spread.collect() if r["g"] == "single"]
    assert one[0]["in_low"] and one[0]["in_high"]


def test_value_ranks(skewed):
    known = skewed.filter("g is not null")
    counts = known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    found = {(r["g"], r["v"]): r["rank"] for r in order.value_ranks(counts, ["g"], "v", "n", P).collect()}
    pdf = known.toPandas()
    pdf["rank"] = pdf.groupby("g")["v"].rank(method="average")
    assert found == {(g, v): r for g, v, r in pdf[["g", "v", "rank"]].drop_duplicates().itertuples(index=False)}


def test_spearman(skewed):
    known = skewed.filter("g is not null")
    plain = {r["g"]: (r["n"], r["rho"]) for r in spearman(known, ["g"], "v", "y", P, False).collect()}
    spread = {r["g"]: (r["n"], r["rho"]) for r in spearman(known, ["g"], "v", "y", P, True).collect()}
    assert plain == spread
    assert plain["single"] == (1, None)
    pdf = known.filter("g = 'hot'").toPandas()
    assert plain["hot"][1] == pytest.approx(pdf["v"].rank().corr(pdf["y"].rank()), abs=1e-8)


def test_spearman_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "g string, v double, y double")
    for spread in (False, True):
        assert spearman(rows, ["g"], "v", "y", P, spread).first()["rho"] is None


def test_hot_keys_keep_every_row(spark):
    """A third of the rows share a key, another third share a key the table lacks."""
    left = spark.createDataFrame([(1 if i % 3 == 0 else None if i % 3 == 1 else i, i) for i in range(3000)],
                                 "k int, id int")
    table = left.filter("k is not null").select("k").distinct().withColumn("x", F.col("k") * 2)
    weights = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    joined = order.skew_join(left, table, ["k"], weights, "w", F.col("id"), "left", tasks=16).toPandas()
    assert len(joined) == 3000 and joined["id"].nunique() == 3000
    known = joined.dropna(subset=["k"])
    assert len(known) == 2000 and (known["x"] == known["k"] * 2).all()
    plain = order.attach(left, table, ["k"], "id", "left").toPandas()
    salted = order.attach(left, table, ["k"], "id", "left", Params(broadcast_rows=10)).toPandas()
    assert sorted(plain["x"].fillna(-1)) == sorted(salted["x"].fillna(-1))


@pytest.fixture(scope="module")
def gaps(spark):
    """Values that are NULL, a group without any value, and a NULL key."""
    rows = [("a", None if i % 6 == 0 else float(i % 9), f"{i:016x}") for i in range(40)]
    rows += [("none", None, f"{i:016x}") for i in range(3)] + [(None, float(i), f"{i:016x}") for i in range(5)]
    return spark.createDataFrame(rows, "g string, v double, query_id string")


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_with_nulls(gaps, keys):
    for rows in (gaps, gaps.filter("false"), gaps.filter("v is null")):
        found = [order.exact_quantiles(rows, keys, "v", [0.0, 0.3, 0.5, 1.0], P, spread).toPandas()
                 for spread in (False, True)]
        sides = [sorted(map(str, f.assign(q=f["q"].map(lambda q: None if q is None else list(q))).itertuples(index=False)))
                 for f in found]
        assert sides[0] == sides[1]
        assert keys or len(sides[0]) == 1


def test_tails_with_nulls(gaps):
    names = ("g", "query_id", "v", "in_low", "in_high")
    plain, spread = (rows_of(order.tail_flags(gaps, ["g"], "v", 0.2, "query_id", P, s), *names) for s in (False, True))
    assert plain == spread
    assert not any(r[3] or r[4] for r in plain if r[2] is None)
    assert sum(r[3] for r in plain if r[0] == "a") == 6


def test_a_hot_key_gets_salts_by_its_share(spark):
    """40% of the rows on one key and 512 tasks: no part of the key holds more than a task's share, and none is lost."""
    left = spark.range(50_000).select("id", F.when(F.col("id") % 5 < 2, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    right = left.select("k", (F.col("k") * 2).alias("v")).distinct()
    weights = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    joined = order.skew_join(left, right, ["k"], weights, "w", F.col("id"), tasks=512)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salts" in plan
    assert joined.count() == 50_000 and joined.filter("v <> k * 2").count() == 0
    salts = left.filter("k = -1").groupBy(F.pmod(F.xxhash64("id"), F.lit(205))).count().agg(F.max("count"), F.count("*")).first()
    assert salts[1] == 205 and salts[0] < 2 * 50_000 / 512


@pytest.mark.parametrize("buckets", [64, 1024])
def test_split_points_balance_and_take_any_column(spark, buckets):
    params = replace(DEFAULT, order_buckets=buckets)
    rows = spark.range(200_000).select(F.exp(F.rand(3) * 9).alias("v")).repartition(16)
    points = order.value_buckets(rows, "v", params)
    assert len(points) == buckets - 1 and points == sorted(points)
    sizes = [r["count"] for r in order.with_value_bucket(rows, "v", points).groupBy("__bucket").count().collect()]
    assert max(sizes) < 2.5 * 200_000 / buckets
    assert order.value_buckets(rows.limit(0), "v", params) == []
    assert order.value_buckets(rows.select(F.lit(None).cast("double").alias("v")), "v", params) == []
    ties = order.value_buckets(rows.select(F.lit(1.0).alias("v")), "v", params)
    assert set(ties) == {1.0}
