"""Samples of huge tables, products beyond doubles, several shards, and long texts without a blank."""

from __future__ import annotations

import itertools
import resource
import warnings

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from choicemill.llm import knn, pieces, ready, secret_scan
from choicemill.llm.common import drawn


def test_a_tiny_share_still_draws(spark):
    rows = spark.range(200_000)
    assert rows.where(drawn(1.0, "id")).count() == 200_000
    assert rows.where(drawn(0.0, "id")).count() == 0
    assert 60 < rows.where(drawn(5e-4, "id")).count() < 150
    assert rows.where(drawn(F.lit(0.25), "id")).count() == pytest.approx(50_000, rel=0.02)
    # A share of 1e-9 keeps its size where a draw over a million steps would round to nothing.
    share, kept = 1e-9, 0
    for base in range(4):
        kept += spark.range(base * 50_000_000, (base + 1) * 50_000_000).where(drawn(share * 1_000, "id")).count()
    assert 150 < kept < 260


def test_an_empty_class_is_noticed(spark):
    ready(spark)
    only = spark.createDataFrame([("identifier_name", 0)], "value string, label int")
    with pytest.warns(UserWarning, match="no labelled samples"):
        model = secret_scan.train(only)
    assert set(model) == {0}
    both = spark.createDataFrame([("identifier_name", 0), ("x9Kq2Lm8", 1)], "value string, label int")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert any(secret_scan.train(both))


# ---------------------------------------------------------------- search

def best_by_hand(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0)), i) for i, b in vectors if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [100, 1 << 26])
@pytest.mark.parametrize(("shard", "block"), [(40, 8), (7, 3), (100_000, 100_000)])
def test_shards_and_blocks_equal_brute_force(spark, monkeypatch, scale, shard, block):
    monkeypatch.setattr(knn, "LEAF", 5)
    rng = np.random.default_rng(scale % 97)
    vectors = [(int(i), [int(x) for x in rng.integers(-scale, scale, 8)]) for i in range(200)]
    vectors += [(500, vectors[3][1]), (501, vectors[3][1]), (502, [0] * 8), (503, [5]), (504, [])]  # ties and short vectors
    vectors += [(600, vectors[9][1])] * 3  # repeated rows of a candidate
    frame = ready(spark).createDataFrame(vectors, "vec_id long, v array<long>")
    queries = [v for v in vectors if v[0] % 20 == 0 and v[0] < 600]
    got = knn.exact_top_k(frame, frame.where("vec_id % 20 = 0 and vec_id < 600"), 6, shard, block).collect()
    assert sorted(map(tuple, got)) == best_by_hand(vectors, queries, 6)


def test_products_are_exact_or_fail():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1 << 26, 1 << 27, (5, 8)).astype(float), rng.integers(1 << 26, 1 << 27, (7, 8)).astype(float)
    assert knn.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    with pytest.raises(OverflowError):
        knn.product(a * 2.0 ** 30, b)


def test_quantised_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [0.5, -0.01]), (20, [0.25, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]),
            (5, [None, 1.0]), (6, []), (7, [1.0, 1.0])]
    frame = ready(spark).createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, rank int")
    vectors = knn.quantised(frame)
    assert sorted(r.vec_id for r in vectors.collect()) == [1, 6, 7, 20, 20]
    got = sorted(map(tuple, knn.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()))
    assert got == [(20, 1, 1, 1024), (20, 2, 7, 1024), (20, 3, 6, 0)]  # of the two query vectors the smaller, (16, 0)
    none = vectors.limit(0)
    assert knn.exact_top_k(none, none).count() == 0 and knn.exact_top_k(vectors, none).count() == 0


# ---------------------------------------------------------------- segmentation

def all_paths(edges, length):
    def walk(at):
        if at == length:
            yield 0.0, (at,)
            return
        for step in range(1, min(edges.shape[1], length - at) + 1):
            if edges[at, step - 1] > -np.inf:
                for score, path in walk(at + step):
                    yield edges[at, step - 1] + score, (at, *path)
    return sorted(walk(0), reverse=True)


@pytest.mark.parametrize("seed", range(12))
def test_n_best_of_random_lattices(seed):
    rng = np.random.default_rng(seed)
    length, most = int(rng.integers(1, 11)), 4
    edges = -rng.integers(1, 6 if seed % 2 else 1_000, (length, most)).astype(float)  # odd seeds: many ties
    edges[rng.random(edges.shape) < 0.3] = -np.inf
    edges[:, 0] = np.maximum(edges[:, 0], -50)
    forward = np.full(length + 1, -np.inf)
    forward[0] = 0
    for at in range(length):
        for step in range(1, min(most, length - at) + 1):
            forward[at + step] = max(forward[at + step], forward[at] + edges[at, step - 1])
    truth = all_paths(edges, length)
    for n in (1, 2, 4, 50):
        found = pieces.n_best("x" * length, forward, edges, n)
        assert [s for s, _ in found] == [s for s, _ in truth[:n]]
        assert len({p for _, p in found}) == len(found)
        scores = dict((p, s) for s, p in truth)
        assert all(scores[p] == s for s, p in found)


def test_long_text_without_a_blank_stays_small():
    v = pieces.vocabulary(public_tokenizers.path(pieces.MODEL))
    v.forget()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    (found,) = list(pieces.segmentations([text], v, 4))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    v.forget()
    assert len(found) == 4 and grown < 1_000
