"""Smoothing of series by penalised differences: squared ones (Tikhonov) and absolute ones (total variation).

Rows without a value are left out. Series are told apart by their keys (a null key is one); ``order`` has to tell
the rows of a series apart. Results are (keys, order, kept, smoothed).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.operators.recurrence import MOST_GAINS, Linear, _beside, linear_scan


def pivots(weight: float) -> np.ndarray:
    """Pivots of the elimination by position until they settle; they don't depend on the data."""
    found = [1.0 + weight]
    while len(found) < MOST_GAINS:
        found.append(1 + 2 * weight - weight**2 / found[-1])
        if abs(found[-1] - found[-2]) <= 1e-16 * found[-1]:
            break
    return np.array(found)


def tikhonov(df: DataFrame, keys: list[str], order: list[str], value: str, weight: float, keep: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Least sum (x - y)**2 + weight * sum (differences of x)**2.

    The normal equations are tridiagonal; elimination and substitution are linear recurrences, so both
    run as scans over range partitions and a series of any length spreads over tasks.
    """
    d = pivots(weight)
    settled = len(d) - 1
    keep = [c for c in keep or [] if c not in order]
    at = lambda p: d[np.clip(p, 0, settled)]

    def eliminate(i, x):
        return np.where(i == 0, 0.0, weight / at(i - 1))[:, None, None], x[:, :1]

    def substitute(j, x):
        p, last = x[:, 1].astype(np.int64), j == 0
        end = np.where(p == 0, 1.0, 1 + weight - weight**2 / at(p - 1))
        pivot = np.where(last, end, at(p))
        return np.where(last, 0.0, weight / pivot)[:, None, None], (x[:, 0] / pivot)[:, None]

    place = lambda i: (np.zeros((len(i), 1, 1)), i[:, None].astype(float))
    both = Linear(("_z", "_position"), lambda i, x: _beside(eliminate(i, x), place(i)))
    ahead = linear_scan(df.filter(F.col(value).isNotNull()), keys, order, [value], both, [*order, *keep], partitions)
    back = linear_scan(ahead, keys, [F.col(o).desc() for o in order], ["_z", "_position"], Linear(("smoothed",), substitute), [*order, *keep], partitions)
    return back.select(*keys, *order, *keep, "smoothed")


class Slope:
    """Slope of the least cost of a beginning of a series, as a function of its last level.

    It is piecewise linear and rises: a line on the left, a line on the right and knots (place, change of
    factor, change of constant) between. What lies beyond -weight and weight is cut off before the next value.
    """

    def __init__(self, weight: float):
        self.weight, self.knots = weight, deque()
        self.left = self.right = (0.0, 0.0)

    def add(self, y: float) -> None:
        self.left, self.right = [(a + 1, b - y) for a, b in (self.left, self.right)]

    def from_left(self, level: float) -> tuple[float, float, float]:
        a, b = self.left
        while self.knots and a * self.knots[0][0] + b < level:
            _, more, const = self.knots.popleft()
            a, b = a + more, b + const
        return (level - b) / a, a, b

    def from_right(self, level: float) -> tuple[float, float, float]:
        a, b = self.right
        while self.knots and a * self.knots[-1][0] + b > level:
            _, more, const = self.knots.pop()
            a, b = a - more, b - const
        return (level - b) / a, a, b

    def cut(self) -> tuple[float, float]:
        """Bounds between which the level before the next value lies."""
        w = self.weight
        lo, a, b = self.from_left(-w)
        hi, c, d = self.from_right(w)
        self.knots.appendleft((lo, a, b + w))
        self.knots.append((hi, -c, w - d))
        self.left, self.right = (0.0, -w), (0.0, w)
        return lo, hi


def total_variation(df: DataFrame, keys: list[str], order: list[str], value: str, weight: float, keep: list[str] | None = None) -> DataFrame:
    """Least sum (x - y)**2 / 2 + weight * sum of absolute differences of x, exactly (dynamic programming over the slope of the cost).

    Forwards each row gets the bounds that its level has whatever follows, backwards each level is the next one moved
    into its bounds. A series passes through one task in each direction; the task holds the knots, not the series.
    """
    keep = [c for c in keep or [] if c not in order]
    n, by = len(keys) + len(order) + len(keep), [F.col(k).asc_nulls_first() for k in keys]
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_series")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, *order, *keep, F.col(value).cast("double").alias("_x"), series).repartition(*keys)
    rows = rows.withColumn("_last", F.lead(F.lit(1)).over(W.partitionBy(*keys).orderBy(*order)).isNull()).sortWithinPartitions(*by, *order)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])

    def forwards(batches):
        now, slope = None, None
        for b in batches:
            lo, hi = np.empty(b.num_rows), np.empty(b.num_rows)
            for k, (y, name, last) in enumerate(zip(*(c.to_pylist() for c in b.columns[n:]))):
                if name != now:
                    now, slope = name, Slope(weight)
                slope.add(y)
                if last:
                    lo[k] = hi[k] = slope.from_left(0.0)[0]
                else:
                    lo[k], hi[k] = slope.cut()
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(lo), pa.array(hi)], [*b.schema.names[:n], "_lo", "_hi"])

    def backwards(batches):
        x = 0.0
        for b in batches:
            out = np.empty(b.num_rows)
            for k, (lo, hi) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                x = lo if x < lo else hi if x > hi else x  # the last row of a series has one level only
                out[k] = x
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out)], [*b.schema.names[:n], "smoothed"])

    bounds = rows.mapInArrow(forwards, f"{kept}, _lo double, _hi double")
    bounds = bounds.repartition(*keys).sortWithinPartitions(*by, *[F.col(o).desc() for o in order])
    return bounds.mapInArrow(backwards, f"{kept}, smoothed double")
