"""Signal features over ordered samples: amplitude statistics, spectra by sums, detectors over windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.operators.windows import Series, runs


def time_features(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Amplitude features and population moments (excess kurtosis), 0 where they aren't defined."""
    v = F.col(x)
    n, rms, peak = F.count(v), F.sqrt(F.avg(v * v)), F.max(F.abs(v))
    safe = lambda c, e: F.when(c, e).otherwise(0.0)
    return df.groupBy(*keys).agg(
        rms.alias("rms"), peak.alias("peak"), (F.max(v) - F.min(v)).alias("peak_to_peak"), safe(rms > 1e-12, peak / rms).alias("crest_factor"), F.sum(v * v).alias("energy"),
        F.avg(v).alias("mean"), safe((n >= 2) & (F.var_pop(v) > 1e-12), F.skewness(v)).alias("skewness"), safe((n >= 2) & (F.var_pop(v) > 1e-12), F.kurtosis(v)).alias("kurtosis"),
    )


def zero_crossing_rate(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Share of neighbouring samples of different sign; 0 counts as positive."""
    sign = F.when(F.col(x) >= 0, 1).otherwise(-1)
    s = df.withColumn("_s", sign).withColumn("_c", F.when(F.lag("_s").over(W.partitionBy(*keys).orderBy(*order)) != F.col("_s"), 1).otherwise(0))
    return s.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, F.sum("_c") / (F.count(F.lit(1)) - 1)).otherwise(0.0).alias("zero_crossing_rate"))


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], x: str, lag: int) -> DataFrame:
    """Un-centred lag product over n - lag."""
    p = df.withColumn("_p", F.col(x) * F.lag(x, lag).over(W.partitionBy(*keys).orderBy(*order)))
    return p.groupBy(*keys).agg(F.avg("_p").alias("autocorrelation"))


def histogram_entropy(df: DataFrame, keys: list[str], x: str, bins: int = 64) -> DataFrame:
    """Base-2 entropy of an equal-width histogram over each key's own range."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = df.join(ends, keys).groupBy(*keys, at.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("_n") * F.log2("_n")) / total).alias("entropy"))


def taper(kind: str, i: Column, n: Column) -> Column:
    """Window weight of sample i (from 0) of n."""
    # Cosine-sum coefficients.
    terms = {"hanning": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168), "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)}[kind]
    phase = 2 * math.pi * i / (n - 1)
    return sum(((-1) ** k * a * F.cos(k * phase) for k, a in enumerate(terms)), F.lit(0.0))


def spectrum(df: DataFrame, keys: list[str], order: list[str], x: str, bins: int, window: str | None = None) -> DataFrame:
    """Rows (keys, bin, power): the first ``bins`` DFT bins of each series as sums of products, partially combined.

    The right form for a stated number of bins; a series is never gathered.
    """
    w = W.partitionBy(*keys)
    s = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    v = F.col(x) * taper(window, F.col("_i"), F.col("_n")) if window else F.col(x)
    each = s.select(*keys, v.alias("_v"), "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    phase = 2 * math.pi * F.pmod(F.col("bin").cast("long") * F.col("_i"), F.col("_n")) / F.col("_n")
    total = each.groupBy(*keys, "bin").agg(F.sum(F.col("_v") * F.cos(phase)).alias("re"), F.sum(F.col("_v") * F.sin(phase)).alias("im"), F.first("_n").alias("_n"))
    return total.select(*keys, "bin", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("_n")).alias("power"))


def spectral_summary(power: DataFrame, keys: list[str], bin_col: str = "bin", power_col: str = "power") -> DataFrame:
    """Centroid, spread, entropy and flatness of spectra in long form."""
    f, p = F.col(bin_col), F.col(power_col)
    total = F.sum(p)
    centroid = F.sum(f * p) / total
    return power.groupBy(*keys).agg(
        centroid.alias("centroid"), F.sqrt(F.greatest(F.sum(f * f * p) / total - centroid * centroid, F.lit(0.0))).alias("spread"),
        (F.log2(total) - F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)) / total).alias("entropy"), (F.exp(F.avg(F.log(F.greatest(p, F.lit(1e-300))))) / F.avg(p)).alias("flatness"),
    )


def cfar(df: DataFrame, keys: list[str], order: list[str], x: str, guard: int, train: int, alpha: float, kind: str = "ca") -> DataFrame:
    """``df`` with detected: a cell over alpha times the noise of ``train`` cells on each side beyond ``guard`` cells.

    ca: mean of both sides; go, so: greater or lesser side; os: the 3/4 order statistic; tm: mean without a quarter at each end.
    Cells without full sides are not detected.
    """
    s = W.partitionBy(*keys).orderBy(*order)
    left, right = s.rowsBetween(-guard - train, -guard - 1), s.rowsBetween(guard + 1, guard + train)
    full = (F.count(x).over(left) == train) & (F.count(x).over(right) == train)
    a, b = F.avg(x).over(left), F.avg(x).over(right)
    cells = F.array_sort(F.concat(F.collect_list(x).over(left), F.collect_list(x).over(right)))
    if kind == "os":
        noise = F.element_at(cells, F.lit(max(1, (3 * 2 * train) // 4)))
    elif kind == "tm":
        k = (2 * train) // 4
        noise = F.aggregate(F.slice(cells, k + 1, 2 * train - 2 * k), F.lit(0.0), lambda t, v: t + v) / (2 * train - 2 * k)
    else:
        noise = {"ca": (a + b) / 2, "go": F.greatest(a, b), "so": F.least(a, b)}[kind]
    return df.withColumn("detected", F.coalesce(full & (F.col(x) > alpha * F.when(full, noise)), F.lit(False)))


def cfar_2d(df: DataFrame, keys: list[str], x: str, y: str, power: str, guard: int, train: int, alpha: float) -> DataFrame:
    """``df`` with detected: a cell of a grid over alpha times the mean of the cells up to ``guard + train`` away, without those up to ``guard``.

    Box sums are taken along x and then along y, each by one window over a line of the grid. Cells
    whose boxes are not whole, as at the edges, are not detected.
    """
    def along(c):
        return W.partitionBy(*keys, y if c == x else x).orderBy(c)

    wide, near = guard + train, guard
    rows = df.withColumn("_one", F.lit(1))
    rows = rows.withColumns({f"_{n}{r}": F.sum(v).over(along(x).rangeBetween(-r, r)) for r in (wide, near) for n, v in (("s", power), ("n", "_one"))})
    rows = rows.withColumns({f"_{n}_{r}": F.sum(f"_{n}{r}").over(along(y).rangeBetween(-r, r)) for r in (wide, near) for n in "sn"})
    side = 2 * wide + 1
    noise = (F.col(f"_s_{wide}") - F.col(f"_s_{near}")) / (side**2 - (2 * near + 1) ** 2)
    out = rows.withColumn("detected", F.coalesce((F.col(f"_n_{wide}") == side**2) & (F.col(power) > alpha * noise), F.lit(False)))
    return out.select(*df.columns, "detected")


def ca_alpha(cells: int, false_alarm: float) -> float:
    return cells * (false_alarm ** (-1.0 / cells) - 1.0)


def clusters(detected: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Runs of detected cells: start, length and peak."""
    r = runs(detected, keys, order, "detected").filter("detected")
    return r.groupBy(*keys, "run").agg(F.min(F.struct(*order)).getField(order[0]).alias("start"), F.count(F.lit(1)).alias("length"), F.max(x).alias("peak"))


def peaks(df: DataFrame, keys: list[str], order: list[str], x: str, threshold: float) -> DataFrame:
    """Local maxima above a threshold."""
    s = Series(keys, order)
    ahead = F.lead(x).over(s.order)
    return df.withColumns({"_a": s.lag(x), "_b": ahead}).filter((F.col(x) > threshold) & (F.col(x) > F.col("_a")) & (F.col(x) >= F.col("_b"))).drop("_a", "_b")


def heart_rate_variability(beats: DataFrame, keys: list[str], time: str) -> DataFrame:
    """SDNN and RMSSD in ms, pNN50 in percent and mean rate from beat times in seconds; zeros without intervals."""
    w = W.partitionBy(*keys).orderBy(time)
    rr = beats.withColumn("_rr", F.col(time) - F.lag(time).over(w)).withColumn("_d", F.col("_rr") - F.lag("_rr").over(w))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rr.groupBy(*keys).agg(
        zero(1000.0 * F.stddev_samp("_rr")).alias("sdnn"), zero(1000.0 * F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmssd"),
        zero(100.0 * F.avg((F.abs(F.col("_d")) > 0.05).cast("double"))).alias("pnn50"), zero(F.when(F.avg("_rr") > 0, 60.0 / F.avg("_rr"))).alias("mean_rate"),
    )


#: Ships of a cell that meet their neighbours in one part.
SHIPS = 256


def closest_approach(ships: DataFrame, time: str, id_col: str, x: str, y: str, vx: str, vy: str, cell: float) -> DataFrame:
    """Closest point of approach of pairs that are in the same or a neighbouring grid cell at one time.

    Every such pair is a row of the result; a cell of many ships is dealt over parts of ``SHIPS`` of them, which tasks share evenly.
    """
    a = ships.select(F.col(time).alias("t"), *[F.col(c).alias(f"a_{n}") for n, c in (("id", id_col), ("x", x), ("y", y), ("vx", vx), ("vy", vy))])
    b = ships.select(F.col(time).alias("t"), *[F.col(c).alias(f"b_{n}") for n, c in (("id", id_col), ("x", x), ("y", y), ("vx", vx), ("vy", vy))])
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = a.withColumn("s", F.explode(shifts)).withColumns({"cx": F.floor(F.col("a_x") / cell) + F.col("s.i"), "cy": F.floor(F.col("a_y") / cell) + F.col("s.j")}).drop("s")
    b = b.withColumns({"cx": F.floor(F.col("b_x") / cell), "cy": F.floor(F.col("b_y") / cell)})
    most = b.groupBy("t", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // SHIPS) or 1
    a = a.withColumn("_part", F.pmod(F.xxhash64("a_id"), F.lit(parts)))
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    # a stated number of tasks: little is read and much is made
    by = [int(ships.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "cx", "cy", "_part"]
    p = a.repartition(*by).join(b.repartition(*by), ["t", "cx", "cy", "_part"]).filter("a_id < b_id")
    dx, dy, ux, uy = (F.col(f"b_{c}") - F.col(f"a_{c}") for c in ("x", "y", "vx", "vy"))
    speed = ux * ux + uy * uy
    tcpa = F.when(speed < 1e-12, 0.0).otherwise(-(dx * ux + dy * uy) / speed)
    cpa = F.sqrt(F.pow(dx + ux * tcpa, F.lit(2.0)) + F.pow(dy + uy * tcpa, F.lit(2.0)))
    return p.select("t", F.col("a_id").alias("a"), F.col("b_id").alias("b"), tcpa.alias("tcpa"), cpa.alias("cpa"))


def encounter(bearing: Column) -> Column:
    """Encounter by relative bearing in degrees."""
    b = F.pmod(bearing + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(b) <= 15, "head_on").when(F.abs(b) >= 112.5, "overtaking").when(b > 0, "give_way").otherwise("stand_on")


# Shewhart charts


def shewhart(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """``df`` with z (0 where the series doesn't vary) and rule: the first of the four zone rules that fires on each row, 0 if none."""
    by = W.partitionBy(*keys)
    z = F.when(F.stddev_samp(x).over(by) > 0, (F.col(x) - F.avg(x).over(by)) / F.stddev_samp(x).over(by)).otherwise(0.0)
    s = by.orderBy(*order)
    d = df.withColumn("z", z)
    some = lambda test, n: F.sum(F.when(test, 1).otherwise(0)).over(s.rowsBetween(1 - n, 0))
    side = lambda n, least, limit: (some(F.col("z") > limit, n) >= least) | (some(F.col("z") < -limit, n) >= least)
    rule = F.when(F.abs(F.col("z")) > 3, 1).when(side(3, 2, 2.0), 2).when(side(5, 4, 1.0), 3).when(side(8, 8, 0.0), 4).otherwise(0)
    return d.withColumn("rule", rule)


def cusum(df: DataFrame, keys: list[str], order: list[str], x: str, target: float, sigma: float, k: float, h: float) -> DataFrame:
    """``df`` with tabular CUSUM sums in sigma units that are not reset by a signal.

    S = P - min(0, running minimum of P) for the running sum P of z - k, so two window sums do.
    """
    s = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    z = (F.col(x) - target) / sigma
    d = df.withColumns({"_up": F.sum(z - k).over(s), "_down": F.sum(-z - k).over(s)})
    d = d.withColumns({"cusum_high": F.col("_up") - F.least(F.min("_up").over(s), F.lit(0.0)), "cusum_low": F.col("_down") - F.least(F.min("_down").over(s), F.lit(0.0))})
    return d.withColumn("signal", F.when(F.col("cusum_high") > h, "high").when(F.col("cusum_low") > h, "low")).drop("_up", "_down")


def rocof(df: DataFrame, keys: list[str], time: str, frequency: str) -> DataFrame:
    """Rate of change of frequency: the least-squares slope, 0 with fewer than two samples."""
    return df.groupBy(*keys).agg(F.when((F.count(F.lit(1)) >= 2) & (F.var_pop(time) > 0), F.covar_pop(time, frequency) / F.var_pop(time)).otherwise(0.0).alias("rocof"))
