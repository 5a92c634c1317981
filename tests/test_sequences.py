"""Penalised smoothing, time warping and hidden states against plain computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograin.operators import hidden_states as H
from heliograin.operators import levels, warping


def noisy(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, i, float(rng.normal() + 3 * (i // 7 % 2))) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows + [("a", 10_000, None)], "k string, i long, x double").repartition(5, "x")
    return {k: np.array([x for s, _, x in rows if s == k]) for k in sizes}, df


def in_order(found, k):
    return np.array([r.smoothed for r in sorted((r for r in found if r.k == k), key=lambda r: r.i)])


SIZES = {"long": 900, "a": 1, "b": 2, "c": 3, None: 40}


@pytest.mark.parametrize("weight, partitions", [(0.0, 3), (0.5, 1), (20.0, 7), (1e4, 5)])
def test_tikhonov_solves_its_equations(spark, weight, partitions):
    ys, df = noisy(spark, SIZES)
    found = levels.tikhonov(df, ["k"], ["i"], "x", weight, partitions=partitions).collect()
    assert len(found) == sum(SIZES.values())
    for k, y in ys.items():
        x = in_order(found, k)
        d = np.diff(x)
        left = x - y - weight * (np.r_[d, 0] - np.r_[0, d])
        assert np.abs(left).max() < 1e-9 * (1 + weight)


@pytest.mark.parametrize("weight", [0.0, 0.3, 2.0, 500.0])
def test_total_variation_is_optimal(spark, weight):
    """Running sums of x - y stay within the weight, meet it at jumps, and end at nothing: true of the minimum alone."""
    ys, df = noisy(spark, SIZES)
    found = levels.total_variation(df, ["k"], ["i"], "x", weight).collect()
    assert len(found) == sum(SIZES.values())
    for k, y in ys.items():
        x = in_order(found, k)
        s, d = np.cumsum(x - y), np.diff(x)
        assert abs(s[-1]) < 1e-8 and np.abs(s).max() <= weight + 1e-8
        assert np.allclose(s[:-1][d > 1e-9], weight, atol=1e-8) and np.allclose(s[:-1][d < -1e-9], -weight, atol=1e-8)


def test_smoothing_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, i long, x double")
    assert levels.tikhonov(empty, ["k"], ["i"], "x", 1.0).count() == 0 == levels.total_variation(empty, ["k"], ["i"], "x", 1.0).count()


def plain_warping(a, b, step):
    n, m = len(a), len(b)
    t = np.full((n + 1, m + 1), np.inf)
    t[0, 0] = 0
    for i in range(1, n + 1):
        centre = max(1, min(m, (i * m + n // 2) // n))
        for j in range(1, m + 1):
            if step is None or abs(j - centre) <= step:
                t[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return t[n, m]


@pytest.mark.parametrize("step", [None, 0, 1, 4])
def test_warped_distance_and_its_bound(step):
    rng = np.random.default_rng(1)
    for n, m in itertools.product((1, 2, 7, 30), repeat=2):
        a, b = rng.normal(size=n), rng.normal(size=m)
        want = plain_warping(a, b, step)
        assert warping.squared(a, b, step) == pytest.approx(want)
        assert warping.lower_bound(a, b, step) <= want
        assert warping.squared(a, b, step, want) == pytest.approx(want)


@pytest.mark.parametrize("step, block", [(None, 1_000_000), (3, 50)])
def test_nearest_equals_all_comparisons(spark, monkeypatch, step, block):
    monkeypatch.setattr(warping, "BLOCK_VALUES", block)
    rng = np.random.default_rng(4)
    held = {k: np.cumsum(rng.normal(size=int(rng.integers(8, 14)))) for k in range(60)}
    held[61] = held[20].copy()
    rows = [(k, i, float(v)) for k, s in held.items() for i, v in enumerate(s)] + [(None, 0, 1.0), (5, 99, None)]
    series = warping.gathered(spark.createDataFrame(rows, "k long, i int, x double"), "k", ["i"], "x")
    queries = series.filter("key % 20 = 0")
    got = {(r.query, r["rank"]): (r.key, r.distance) for r in warping.nearest(series, queries, 3, step).collect()}
    for q in (0, 20, 40):
        want = sorted((plain_warping(held[q], s, step), k) for k, s in held.items() if k != q)
        want = [(w, k) for w, k in want if w < np.inf][:3]
        assert [got[q, i + 1][0] for i in range(len(want))] == [k for _, k in want]
        assert [got[q, i + 1][1] for i in range(len(want))] == pytest.approx([math.sqrt(w) for w, _ in want])
    total = warping.effort(series, queries, 3, step).first()
    assert total.seen == 3 * 60 and total.tried < total.seen
    assert warping.nearest(series.limit(0), queries, 3, step).count() == 0 == warping.nearest(series, queries.limit(0), 3, step).count()


def plain_round(model, seqs):
    """Expected counts by summing over all paths."""
    n = len(model.start)
    starts, moves, emits, likely = np.zeros(n), np.zeros((n, n)), np.zeros(model.emit.shape), 0.0
    for s in seqs:
        ways = {}
        for p in itertools.product(range(n), repeat=len(s)):
            v = model.start[p[0]] * model.emit[p[0], s[0]]
            for t in range(1, len(s)):
                v *= model.move[p[t - 1], p[t]] * model.emit[p[t], s[t]]
            ways[p] = v
        whole = sum(ways.values())
        likely += math.log(whole)
        for p, v in ways.items():
            starts[p[0]] += v / whole
            for t, x in enumerate(s):
                emits[p[t], x] += v / whole
                if t:
                    moves[p[t - 1], p[t]] += v / whole
    return starts, moves, emits, likely


def test_training_equals_all_paths_and_gains(spark):
    rng = np.random.default_rng(8)
    seqs = {k: rng.integers(0, 3, int(rng.integers(1, 7))) for k in range(25)}
    rows = [(k, i, "xyz"[s]) for k, x in seqs.items() for i, s in enumerate(x)] + [(None, 0, "x"), (3, 77, None)]
    table = H.sequences(spark.createDataFrame(rows, "k long, i int, s string"), "k", ["i"], "s")
    assert table.count() == 25 and H.alphabet(table) == ["x", "y", "z"]
    model = H.Model.first(["x", "y", "z"], 2)
    starts, moves, emits, likely = plain_round(model, seqs.values())
    got, before = H.one_round(table, model)
    assert before == pytest.approx(likely)
    assert np.allclose(got.start, starts / starts.sum()) and np.allclose(got.move, moves / moves.sum(axis=1, keepdims=True)) and np.allclose(got.emit, emits / emits.sum(axis=1, keepdims=True))
    _, history = H.train(table, model, 12, -1.0)
    assert len(history) == 12 and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))


def test_best_path_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    model = H.Model.first(["x", "y"], 3, 5)
    for n in (1, 2, 5):
        s = rng.integers(0, 2, n)
        score = lambda p: model.start[p[0]] * math.prod(model.emit[a, x] for a, x in zip(p, s)) * math.prod(model.move[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        got = tuple(H.best_path(model, s).tolist())
        assert score(got) == pytest.approx(max(map(score, itertools.product(range(3), repeat=n))))
    empty = H.sequences(spark.createDataFrame([], "k long, i int, s string"), "k", ["i"], "s")
    assert H.alphabet(empty) == [] and H.decode(empty, model).count() == 0
    again, likely = H.one_round(empty, model)
    assert likely == 0 and np.allclose(again.move, model.move)


def test_planted_states_are_told_apart(spark):
    """Two states that seldom change, each with its own symbols."""
    rows = spark.range(40_000).select((F.col("id") / 400).cast("long").alias("k"), (F.col("id") % 400).alias("i"))
    state = (F.col("i") / 50).cast("int") % 2
    rows = rows.withColumn("truth", state).withColumn("s", F.when(F.rand(3) < 0.9, state).otherwise(1 - state).cast("string"))
    seqs = H.sequences(rows, "k", ["i"], "s", "truth")
    model, _ = H.train(seqs, H.Model.first(["0", "1"], 2, 1), 60, 0.1)
    right = H.decode(seqs, model).agg(F.avg((F.col("kept") == F.col("state")).cast("double"))).first()[0]
    assert max(right, 1 - right) > 0.97 and min(np.diag(model.move)) > 0.9
