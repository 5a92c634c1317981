"""Regression with high breakdown against planted lines and plain computations."""

import numpy as np
import pytest

from heliograin.operators import fitting


def test_planted_line_among_many_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 1500)
    y = 3 + 2 * x + rng.normal(0, 0.1, 1500)
    y[:600] = 80 - 5 * x[:600] + rng.normal(0, 1, 600)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf"))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    found = fitting.high_breakdown(df, ["x"], "y", coverage=0.55, starts=12, screens=2)
    assert found.coefficients == pytest.approx([3, 2], abs=0.03) and found.converged
    assert found.retained == int(np.ceil(0.55 * 1500)) and found.rejected == 1500 - found.retained
    # the trimmed line is a fixed point of the plain concentration step
    design = np.c_[np.ones(1500), x]
    kept = np.argsort(np.abs(y - design @ found.trimmed))[: found.retained]
    assert np.linalg.lstsq(design[kept], y[kept], rcond=None)[0] == pytest.approx(found.trimmed, abs=1e-6)
    assert np.abs(y - design @ found.trimmed)[kept].max() == pytest.approx(found.bound)
    # the scale meets its equation, the line the weighted normal equations
    u = np.minimum(np.abs(y - design @ found.trimmed) / (1.5476 * found.scale), 1)
    assert np.mean(1 - (1 - u**2) ** 3) == pytest.approx(0.5, abs=1e-6)
    r = y - design @ found.coefficients
    w = np.where(np.abs(r) < 4.685 * found.scale, (1 - (r / (4.685 * found.scale)) ** 2) ** 2, 0)
    assert np.abs(design.T @ (w * r)).max() < 1e-4


def test_exact_lines_and_errors(spark):
    df = spark.createDataFrame([(float(i), 1.0 + 2 * i if i % 4 else 500.0) for i in range(80)], "x double, y double")
    found = fitting.high_breakdown(df, ["x"], "y", coverage=0.6, starts=10, screens=1)
    assert found.coefficients == pytest.approx([1, 2], abs=1e-6) and found.rejected >= 20
    with pytest.raises(ValueError):
        fitting.high_breakdown(df.limit(2), ["x"], "y")
    with pytest.raises(ValueError):
        fitting.high_breakdown(df, ["x"], "y", coverage=0.4)
    with pytest.raises(ValueError, match="singular"):
        fitting.high_breakdown(spark.createDataFrame([(1.0, float(i)) for i in range(9)], "x double, y double"), ["x"], "y")
    with pytest.raises(ValueError, match="range of doubles|singular"):
        fitting.high_breakdown(spark.createDataFrame([(float(i), 1.7e308 * (-1) ** i) for i in range(1, 7)], "x double, y double"), ["x"], "y")


def test_ranks_are_exact_in_any_order_and_range(spark):
    rng = np.random.default_rng(3)
    a = np.r_[np.zeros(40), np.full(200, 3.5), rng.uniform(0, 1, 300), 10.0 ** rng.uniform(-300, 300, 160)]
    b = np.r_[np.full(699, 7.0), 5e-324]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(5)
    for rank in (1, 40, 41, 333, 420, 699, 700):
        assert fitting.at_rank(df, [df.a, df.b], rank) == [np.sort(a)[rank - 1], np.sort(b)[rank - 1]]
    assert fitting.at_rank(df.filter("a <= 3.5"), [df.a], 50, (0.0, 4.0)) == [np.sort(a[a <= 3.5])[49]]


def test_steps_near_the_end_leave_most_rows_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.integers(1, 51, 4000).astype(float), rng.uniform(900, 105000, 4000)
    read = spark.sparkContext.accumulator(0)

    def row(r):
        read.add(1)
        return r

    df = spark.createDataFrame(spark.sparkContext.parallelize([(float(a), float(b)) for a, b in zip(x, y)], 2).map(row), "x double, y double")
    found = fitting.high_breakdown(df, ["x"], "y", starts=2, screens=1, refine=False)
    assert found.converged and found.steps >= 20 and read.value <= 40 * 4000
    # a plain step leaves the line where it is; narrow bands, taken anew all the time, come to the same
    design = np.c_[np.ones(4000), x]
    off = np.abs(y - design @ found.trimmed)
    assert found.bound == pytest.approx(np.sort(off)[2999], rel=1e-12) and found.retained == 3000
    assert np.linalg.lstsq(design[off <= found.bound], y[off <= found.bound], rcond=None)[0] == pytest.approx(found.trimmed, rel=1e-8)
    monkeypatch.setattr(fitting, "SIDE", 0.0005)
    again = fitting.high_breakdown(df, ["x"], "y", starts=2, screens=1, refine=False)
    assert again.trimmed == pytest.approx(found.trimmed, rel=1e-9) and again.steps == found.steps and again.retained == 3000
