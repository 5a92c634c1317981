"""Trailing and centred window operators over ordered series.

Every operator takes the partition keys and the order of a series, so many
series run side by side, and adds columns by window functions. Trailing values are null until a window is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Series:
    """Window columns of one series layout: ``keys`` partition it, ``order`` sorts it."""

    def __init__(self, keys: list[str], order: list[str]):
        self.keys, self.by = keys, order

    @property
    def order(self):
        return W.partitionBy(*self.keys).orderBy(*self.by)

    def trailing(self, n: int):
        return self.order.rowsBetween(1 - n, 0)

    def full(self, column: Column, n: int) -> Column:
        return F.when(F.count(F.lit(1)).over(self.trailing(n)) == n, column)

    def lag(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.order)

    def difference(self, c: str, n: int = 1) -> Column:
        return F.col(c) - self.lag(c, n)

    momentum = difference

    def sma(self, c: str, n: int) -> Column:
        return self.full(F.avg(c).over(self.trailing(n)), n)

    def rolling(self, function, c: str, n: int) -> Column:
        return self.full(function(c).over(self.trailing(n)), n)

    def rolling_max(self, c: str, n: int) -> Column:
        return self.rolling(F.max, c, n)

    def rolling_min(self, c: str, n: int) -> Column:
        return self.rolling(F.min, c, n)

    def roc(self, c: str, n: int) -> Column:
        base = self.lag(c, n)
        return F.when(F.abs(base) > 1e-12, 100.0 * (F.col(c) - base) / base)

    def zscore(self, c: str, n: int) -> Column:
        sd = F.stddev_samp(c).over(self.trailing(n))
        return self.full(F.when(sd > 1e-12, (F.col(c) - F.avg(c).over(self.trailing(n))) / sd).otherwise(0.0), n)

    def bollinger(self, c: str, n: int, k: float) -> tuple[Column, Column, Column]:
        mid, sd = F.avg(c).over(self.trailing(n)), F.stddev_pop(c).over(self.trailing(n))
        return self.full(mid - k * sd, n), self.full(mid, n), self.full(mid + k * sd, n)

    def cycle_rms(self, c: str, n: int) -> Column:
        return self.full(F.sqrt(F.avg(F.col(c) * F.col(c)).over(self.trailing(n))), n)

    def true_range(self, high: str, low: str, close: str) -> Column:
        before = self.lag(close)
        return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))

    def stochastic(self, high: str, low: str, close: str, n: int) -> Column:
        top, bottom = F.max(high).over(self.trailing(n)), F.min(low).over(self.trailing(n))
        return self.full(F.when(top - bottom > 1e-12, 100.0 * (F.col(close) - bottom) / (top - bottom)).otherwise(50.0), n)

    def williams_r(self, high: str, low: str, close: str, n: int) -> Column:
        top, bottom = F.max(high).over(self.trailing(n)), F.min(low).over(self.trailing(n))
        return self.full(F.when(top - bottom > 1e-12, -100.0 * (top - F.col(close)) / (top - bottom)).otherwise(-50.0), n)

    def cci(self, tp: str, n: int) -> Column:
        """(TP - SMA) / (0.015 * mean absolute deviation of the same window)."""
        mean, held = F.avg(tp).over(self.trailing(n)), F.collect_list(tp).over(self.trailing(n))
        mad = F.aggregate(held, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
        return self.full(F.when(mad > 1e-12, (F.col(tp) - mean) / (0.015 * mad)).otherwise(0.0), n)

    def signed_volume(self, close: str, volume: str) -> Column:
        """One bar's part of the on-balance volume; its running sum starts at 0."""
        return F.coalesce(F.signum(F.col(close) - self.lag(close)) * F.col(volume), F.lit(0.0))

    def running_sum(self, c: Column | str) -> Column:
        return F.sum(c).over(self.order.rowsBetween(W.unboundedPreceding, 0))

    def vwap(self, tp: str, volume: str, n: int) -> Column:
        v = F.sum(volume).over(self.trailing(n))
        return self.full(F.when(F.abs(v) > 1e-12, F.sum(F.col(tp) * F.col(volume)).over(self.trailing(n)) / v).otherwise(0.0), n)

    def chaikin_money_flow(self, high: str, low: str, close: str, volume: str, n: int) -> Column:
        spread = F.col(high) - F.col(low)
        flow = F.when(spread > 1e-12, ((F.col(close) - F.col(low)) - (F.col(high) - F.col(close))) / spread * F.col(volume)).otherwise(0.0)
        v = F.sum(volume).over(self.trailing(n))
        return self.full(F.when(F.abs(v) > 1e-12, F.sum(flow).over(self.trailing(n)) / v).otherwise(0.0), n)

    def donchian(self, high: str, low: str, n: int) -> tuple[Column, Column, Column]:
        top, bottom = F.max(high).over(self.trailing(n)), F.min(low).over(self.trailing(n))
        return self.full(top, n), self.full(bottom, n), self.full((top + bottom) / 2, n)


def typical_price(high: str, low: str, close: str) -> Column:
    return (F.col(high) + F.col(low) + F.col(close)) / 3


def money_flow_index(df: DataFrame, keys: list[str], order: list[str], tp: str, volume: str, n: int) -> DataFrame:
    """``df`` with mfi: 100 where nothing flows out."""
    s = Series(keys, order)
    step = df.withColumn("_dir", s.difference(tp)).withColumn("_flow", F.col(tp) * F.col(volume))
    up = F.sum(F.when(F.col("_dir") > 0, F.col("_flow")).otherwise(0.0)).over(s.trailing(n))
    down = F.sum(F.when(F.col("_dir") < 0, F.col("_flow")).otherwise(0.0)).over(s.trailing(n))
    ready = F.count("_dir").over(s.trailing(n)) == n
    return step.withColumn("mfi", F.when(ready, F.when(down < 1e-12, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / down)))).drop("_dir", "_flow")


def on_balance_volume(df: DataFrame, keys: list[str], order: list[str], close: str, volume: str) -> DataFrame:
    s = Series(keys, order)
    return df.withColumn("_sv", s.signed_volume(close, volume)).withColumn("obv", s.running_sum("_sv")).drop("_sv")


def centred(df: DataFrame, keys: list[str], order: list[str], c: str, half: int, fold) -> DataFrame:
    """``df`` with _window (a mirror-padded list of 2 * half + 1 values around each row) folded into column smooth."""
    w = W.partitionBy(*keys).orderBy(*order)
    full = W.partitionBy(*keys)
    held = F.collect_list(c).over(w.rowsBetween(-half, half))
    left, n = F.row_number().over(w), F.count(F.lit(1)).over(full)
    framed = df.withColumns({"_w": held, "_i": left, "_n": n})
    here = F.when(F.col("_i") <= half, F.col("_i")).otherwise(half + 1)  # the row's own place in its list
    # a place outside the series reads the mirrored one (the edge value itself isn't repeated)
    at = lambda k: (
        F.when(F.col("_i") + k < 1, here + (2 - 2 * F.col("_i") - k)).when(F.col("_i") + k > F.col("_n"), here + (2 * F.col("_n") - 2 * F.col("_i") - k)).otherwise(here + k)
    )
    inside = lambda p: F.least(F.greatest(p, F.lit(1)), F.size("_w"))
    window = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.element_at("_w", inside(at(k)).cast("int")))
    return framed.withColumn("_window", window).withColumn("smooth", fold(F.col("_window"))).drop("_w", "_i", "_n", "_window")


def mean_of(window: Column) -> Column:
    return F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / F.size(window)


def median_of(window: Column) -> Column:
    s, n = F.array_sort(window), F.size(window)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2


def kernel_of(weights: list[float]):
    """Weighted mean with fixed weights (Gaussian and local-polynomial smoothing)."""
    total = sum(weights)
    kernel = F.array(*[F.lit(w / total) for w in weights])
    return lambda window: F.aggregate(F.zip_with(window, kernel, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def gaussian_weights(sigma: float, half: int) -> list[float]:
    import math

    return [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]


def polynomial_weights(degree: int, half: int) -> list[float]:
    """Least-squares weights of the centre point of a local polynomial."""
    import numpy as np

    x = np.arange(-half, half + 1, dtype=float)
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0].tolist()


def alpha_trimmed(fraction: float):
    def fold(window: Column) -> Column:
        k = F.floor(F.size(window) * fraction).cast("int")
        kept = F.slice(F.array_sort(window), k + 1, F.size(window) - 2 * k)
        return mean_of(kept)

    return fold


def hampel(df: DataFrame, keys: list[str], order: list[str], c: str, half: int, sigmas: float) -> DataFrame:
    """``df`` with the median filter's value (smooth), the impulse mask and the repaired value."""
    both = lambda w: F.struct(median_of(w).alias("m"), median_of(F.transform(w, lambda x: F.abs(x - median_of(w)))).alias("d"))
    found = centred(df, keys, order, c, half, both)
    scale = 1.4826 * F.col("smooth.d")
    mask = (scale > 0) & (F.abs(F.col(c) - F.col("smooth.m")) > sigmas * scale)
    return found.withColumn("impulse", mask).withColumn("repaired", F.when(mask, F.col("smooth.m")).otherwise(F.col(c))).withColumn("smooth", F.col("smooth.m"))


def total_variation(df: DataFrame, keys: list[str], order: list[str], c: str) -> DataFrame:
    step = df.withColumn("_d", F.abs(Series(keys, order).difference(c)))
    return step.groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("total_variation"))


def reversals(df: DataFrame, keys: list[str], order: list[str], c: str) -> DataFrame:
    """Turning points of a series: its ends and every row where the direction changes; of equal neighbours the last."""
    s = Series(keys, order)
    last = df.withColumn("_next", F.lead(c).over(s.order)).filter((F.col("_next") != F.col(c)) | F.col("_next").isNull()).drop("_next")
    step = last.withColumns({"_a": s.difference(c), "_b": F.lead(c).over(s.order) - F.col(c)})
    return step.filter("_a is null or _b is null or _a * _b < 0").drop("_a", "_b")


def runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with run: a number for each run of equal labels (gaps and islands)."""
    s = Series(keys, order)
    change = F.when(s.lag(label).eqNullSafe(F.col(label)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", s.running_sum("_c")).drop("_c")


def voltage_class(ratio: Column) -> Column:
    return F.when(ratio < 0.1, "interruption").when(ratio < 0.9, "sag").when(ratio > 1.1, "swell").otherwise("normal")


def voltage_events(df: DataFrame, keys: list[str], order: list[str], ratio: str) -> DataFrame:
    """Runs of one class other than normal: length and extreme ratio."""
    named = runs(df.withColumn("class", voltage_class(F.col(ratio))), keys, order, "class").filter("class <> 'normal'")
    extreme = F.when(F.first("class") == "swell", F.max(ratio)).otherwise(F.min(ratio))
    return named.groupBy(*keys, "run").agg(F.first("class").alias("class"), F.count(F.lit(1)).alias("length"), extreme.alias("extreme"))


def nearest_step(steps: DataFrame, appliances: DataFrame, step: str, power: str, name: str, tolerance: float) -> DataFrame:
    """Each step's appliance: the nearest power within a relative tolerance.

    The appliance list is a literal table of the caller; steps meet it by a
    range bucket of the logarithm of power, so no pair outside the tolerance's buckets is made.
    """
    import math

    width = math.log1p(tolerance) if tolerance > 0 else 1e-9
    bucket = lambda c: F.floor(F.log(F.abs(c)) / width)
    left = steps.filter(F.abs(F.col(step)) > 1e-12).withColumn("_k", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: bucket(F.col(step)) + d)))
    right = appliances.withColumn("_k", bucket(F.col(power)))
    near = left.join(right, "_k").withColumn("_off", F.abs(F.abs(F.col(step)) - F.col(power))).filter(F.col("_off") <= tolerance * F.col(power))
    return near.groupBy(*steps.columns).agg(F.min_by(name, F.struct("_off", name)).alias(name), F.min("_off").alias("off"))


def forecast_errors(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """mae, rmse and mape; an actual value of zero makes mape an error."""
    e = F.col(actual) - F.col(predicted)
    ratio = F.when(F.col(actual) == 0, F.raise_error("mape needs actual values other than zero").cast("double")).otherwise(F.abs(e / F.col(actual)))
    return df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100.0 * F.avg(ratio)).alias("mape"))


def interpolate(points: DataFrame, nodes: DataFrame, keys: list[str], x: str, y: str, kind: str = "linear") -> DataFrame:
    """``points`` with the value at x between its neighbouring nodes: union, then first and last non-null by one window.

    Outside the nodes the linear kind extends the end segment; the nearest kind takes the left node on a tie.
    """
    w = W.partitionBy(*keys).orderBy(x, "_side")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    before = W.partitionBy(*keys).orderBy(x)
    n = nodes.select(*keys, x, y, F.lag(F.struct(x, y)).over(before).alias("_prev"), F.lead(F.struct(x, y)).over(before).alias("_next"))
    none = [F.lit(None).cast(n.schema[c].dataType).alias(c) for c in (y, "_prev", "_next")]
    both = points.select(*points.columns, *none, F.lit(1).alias("_side")).unionByName(
        n.select(*[F.col(c) if c in n.columns else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], y, "_prev", "_next", F.lit(0).alias("_side"))
    )
    node = F.when(F.col("_side") == 0, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("_prev").alias("p"), F.col("_next").alias("q")))
    seen = both.withColumns({"_l": F.last(node, ignorenulls=True).over(back), "_r": F.first(node, ignorenulls=True).over(ahead)}).filter("_side = 1")
    px = F.col(x)
    if kind == "nearest":
        value = F.when(F.col("_r").isNull(), F.col("_l.y")).when(F.col("_l").isNull(), F.col("_r.y")).when(px - F.col("_l.x") <= F.col("_r.x") - px, F.col("_l.y")).otherwise(F.col("_r.y"))
    else:
        a = lambda f, g: F.when(F.col("_l").isNull(), F.col(f"_r.{f}")).when(F.col("_r").isNull(), F.col(f"_l.p.{x if f == 'x' else y}")).otherwise(F.col(f"_l.{f}"))
        b = lambda f: F.when(F.col("_l").isNull(), F.col(f"_r.q.{x if f == 'x' else y}")).when(F.col("_r").isNull(), F.col(f"_l.{f}")).otherwise(F.col(f"_r.{f}"))
        x0, y0, x1, y1 = a("x", "p"), a("y", "p"), b("x"), b("y")
        value = F.when((x1 == x0) | x1.isNull() | x0.isNull(), F.coalesce(F.col("_l.y"), F.col("_r.y"))).otherwise(y0 + (y1 - y0) * (px - x0) / (x1 - x0))
    return seen.select(*points.columns, value.alias("value"))
