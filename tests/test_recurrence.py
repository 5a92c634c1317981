"""Recurrences and smoothing by the scan against plain loops, with series that cross partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograin.operators import recurrence as R


def table(spark, sizes, nulls=0.0):
    rng = random.Random(7)
    rows = [(k, i, None if rng.random() < nulls else rng.gauss(i / 50, 1.0)) for k, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i long, x double").repartition(5, "x")


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_scan_equals_loops(spark, partitions):
    rows, df = table(spark, {"long": 700, "a": 1, "b": 2, "c": 40, None: 9}, nulls=0.2)
    got = {(r.k, r.i): (r.level, r.trend) for r in R.linear_scan(df, ["k"], ["i"], ["x"], R.double_exponential(0.3, 0.2), ["i"], partitions).collect()}
    assert len(got) == len(rows)
    state = {}
    for k, i, x in rows:
        if x is not None:
            if k not in state:
                state[k] = (x, 0.0)
            else:
                level, trend = state[k]
                now = 0.3 * x + 0.7 * (level + trend)
                state[k] = (now, 0.2 * (now - level) + 0.8 * trend)
        assert got[k, i] == pytest.approx(state[k], abs=1e-9) if k in state else got[k, i] == (None, None)


def smooth(y, ql, qb, r):
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    if len(y) < 3:
        return y
    z, p, zs, ps, preds = np.array([y[0], 0.0]), np.diag([r + ql, r + qb]), [], [], []
    for i, v in enumerate(y):
        if i:
            z, p = f @ z, f @ p @ f.T + np.diag([ql, qb])
        preds.append((z, p))
        k = p @ h.T / (h @ p @ h.T + r)
        z, p = z + (k * (v - z[0])).ravel(), (np.eye(2) - k @ h) @ p
        zs.append(z)
        ps.append(p)
    out = [zs[-1]]
    for i in range(len(y) - 2, -1, -1):
        g = ps[i] @ f.T @ np.linalg.inv(preds[i + 1][1])
        out.append(zs[i] + g @ (out[-1] - preds[i + 1][0]))
    return [s[0] for s in out[::-1]]


@pytest.mark.parametrize("partitions", [1, 4, 11])
def test_smoothing_equals_two_plain_passes(spark, partitions):
    rows, df = table(spark, {"long": 3000, "a": 1, "b": 2, "c": 3, "d": 40})
    got = R.smoothed_trend(df, ["k"], ["i"], "x", 0.01, 0.001, 1.0, partitions=partitions).collect()
    assert len(got) == len(rows)
    for k in "long", "a", "b", "c", "d":
        mine = [r.smoothed for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)]
        assert mine == pytest.approx(smooth([x for s, _, x in rows if s == k], 0.01, 0.001, 1.0), abs=1e-8)


def test_one_long_series_is_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("i"), F.rand(3).alias("x"))
    made = R.linear_scan(rows, ["k"], ["i"], ["x"], R.exponential_mean(0.1), ["i"], 8)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4000
    assert R.linear_scan(rows.limit(0), ["k"], ["i"], ["x"], R.exponential_mean(0.1), ["i"]).count() == 0
