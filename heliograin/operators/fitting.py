"""Models fitted from few sums, and what follows from them: autoregression, quantile and robust regression, propagated uncertainty.

Data are reduced to a row of sums for each series or for each round; only such rows are solved.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def autoregression(df: DataFrame, keys: list[str], order: list[str], value: str, p: int, steps: int = 1) -> DataFrame:
    """Rows (keys, n, intercept, phi_1 .. phi_p, forecast_1 .. forecast_steps): AR(p) by Yule-Walker and the Levinson-Durbin recursion.

    Autocovariances are biased sample ones; a series that doesn't vary has zero
    coefficients and its value as intercept; a series of p values or fewer gives no row. The recursion
    is unrolled into columns over one row of lag sums for each series.
    """
    by = W.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_m": F.avg(value).over(by), "_d": F.row_number().over(by.orderBy(*[F.col(o).desc() for o in order]))})
    x = F.col(value) - F.col("_m")
    lagged = rows.withColumns({f"_x{k}": F.lag(value, k).over(by.orderBy(*order)) - F.col("_m") for k in range(1, p + 1)})
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("_m").alias("mean"), F.sum(x * x).alias("_r0"),
        *[F.coalesce(F.sum(x * F.col(f"_x{k}")), F.lit(0.0)).alias(f"_r{k}") for k in range(1, p + 1)],
        *[F.max(F.when(F.col("_d") == k, F.col(value))).alias(f"_last{k}") for k in range(1, p + 1)],
    ).filter(F.col("n") > p)
    flat = F.col("_r0") / F.col("n") <= 2.220446049250313e-16
    sums = sums.withColumns({f"_rho{k}": F.when(flat, 0.0).otherwise(F.col(f"_r{k}") / F.col("_r0")) for k in range(1, p + 1)})
    sums = sums.withColumns({"_phi1_1": F.col("_rho1"), "_err1": 1 - F.col("_rho1") * F.col("_rho1")})
    for k in range(2, p + 1):
        left = F.col(f"_rho{k}") - sum((F.col(f"_phi{k - 1}_{j}") * F.col(f"_rho{k - j}") for j in range(1, k)), F.lit(0.0))
        sums = sums.withColumn(f"_phi{k}_{k}", F.when(F.abs(f"_err{k - 1}") > 2.220446049250313e-16, left / F.col(f"_err{k - 1}")).otherwise(0.0))
        own = F.col(f"_phi{k}_{k}")
        sums = sums.withColumns({**{f"_phi{k}_{j}": F.col(f"_phi{k - 1}_{j}") - own * F.col(f"_phi{k - 1}_{k - j}") for j in range(1, k)}, f"_err{k}": F.col(f"_err{k - 1}") * (1 - own * own)})
    phi = [F.col(f"_phi{p}_{j}") for j in range(1, p + 1)]
    sums = sums.withColumn("intercept", F.col("mean") * (1 - sum(phi, F.lit(0.0))))
    recent = [F.col(f"_last{k}") for k in range(1, p + 1)]
    for h in range(1, steps + 1):
        sums = sums.withColumn(f"forecast_{h}", F.col("intercept") + sum((c * v for c, v in zip(phi, recent)), F.lit(0.0)))
        recent = [F.col(f"forecast_{h}"), *recent[:-1]]
    return sums.select(*keys, "n", "intercept", *[c.alias(f"phi_{j}") for j, c in enumerate(phi, 1)], *[f"forecast_{h}" for h in range(1, steps + 1)])


def quantile_regression(df: DataFrame, xs: list[str], y: str, tau: float, rounds: int = 50, tolerance: float = 1e-8, floor: float = 1e-6) -> list[float]:
    """Coefficients (intercept first) of the conditional ``tau`` quantile by iteratively reweighted least squares.

    A row weighs tau (above the line) or 1 - tau over its absolute residual, of ``floor`` at
    least: a floor well above rounding keeps single rows on the line from ruling a round. Each
    round is one aggregate of weighted products, of which one row is solved.
    """
    if not 0 < tau < 1:
        raise ValueError("tau lies between 0 and 1")
    rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(xs, 1)], F.col(y).cast("double").alias("y")).dropna().withColumn("x0", F.lit(1.0))
    names = [f"x{k}" for k in range(len(xs) + 1)]
    found = None
    for _ in range(rounds):
        if found is None:
            weight = F.lit(1.0)
        else:
            residual = F.col("y") - sum((F.col(n) * c for n, c in zip(names, found)), F.lit(0.0))
            weight = F.when(residual >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(residual), F.lit(floor))
        w = rows.withColumn("w", weight)
        sums = w.agg(*[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(names) for b in [*names[i:], "y"]]).first()
        if sums["x0x0"] is None:
            raise ValueError("no rows to fit")
        left = np.array([[sums[a + b] if i <= j else sums[b + a] for j, b in enumerate(names)] for i, a in enumerate(names)])
        new = np.linalg.solve(left, np.array([sums[a + "y"] for a in names])).tolist()
        still = found is not None and max(abs(a - b) for a, b in zip(new, found)) <= tolerance
        found = new
        if still:
            break
    return found


def pinball(residual: Column, tau: float) -> Column:
    return residual * F.when(residual >= 0, tau).otherwise(tau - 1)


def combined_uncertainty(f: Callable[..., Column], x: list[Column], u: list[Column], step: float = 1e-4) -> Column:
    """Standard uncertainty of f(x...) of independent inputs with uncertainties u: sensitivities by central differences."""
    total = F.lit(0.0)
    for i, own in enumerate(u):
        up, down = ([v + d if j == i else v for j, v in enumerate(x)] for d in (step, -step))
        part = (f(*up) - f(*down)) / (2 * step) * own
        total = total + part * part
    return F.sqrt(total)


def run_length_one_sided(shift: Column, k: float, h: float) -> Column:
    """Average run length of an upper CUSUM by Siegmund's approximation, in standard deviations; near a shift of k by its series, as the quotient cancels there."""
    b, delta = h + 1.166, shift - k
    x = 2 * delta * b
    near = 1 - x / 3 * (1 - x / 4 * (1 - x / 5 * (1 - x / 6 * (1 - x / 7 * (1 - x / 8)))))
    return F.when(F.abs(x) < 0.1, b * b * near).otherwise((F.exp(-x) + x - 1) / (2 * delta * delta))


def run_length(shift: Column, k: float, h: float) -> Column:
    """Average run length of a two-sided CUSUM under a shift."""
    return 1 / (1 / run_length_one_sided(shift, k, h) + 1 / run_length_one_sided(-shift, k, h))


#: Tuning of Tukey's biweight: half breakdown for the scale, with its target; 95 % efficiency for the line. Fixed values.
SCALE_TUNING, SCALE_TARGET, LINE_TUNING = 1.5476, 0.5, 4.685


@dataclass(frozen=True)
class RobustLine:
    coefficients: list[float]
    trimmed: list[float]
    scale: float
    bound: float
    retained: int
    rejected: int
    steps: int
    converged: bool
    singular: int


#: Bins of an octave in the first sweep for a rank and of a range in those after it; share of all rows that a band has on either side of the last row kept.
OCTAVE, BINS, SIDE = 64, 4096, 0.05


def _sweep(rows: DataFrame, values: list[Column], ranges: dict[int, tuple[float, float]] | None = None) -> dict[int, list]:
    """For each of the values (0 or more, NaN last) its bins in ascending order, as rows (c, least, most): one pass for all of them, by logarithm over all rows or evenly over ``ranges``."""
    each = rows.select(F.posexplode(F.array(*[F.nanvl(v, F.lit(math.inf)) for v in values])).alias("i", "v"))
    if ranges is None:
        at = F.when(F.col("v") > 0, F.floor(F.log2("v") * OCTAVE)).otherwise(-OCTAVE * 2000)
    else:
        low, high = (F.get(F.array(*[F.lit(float(ranges.get(i, (1.0, -1.0))[k])) for i in range(len(values))]), F.col("i")) for k in (0, 1))
        each = each.filter(F.col("v").between(low, high))
        at = F.when(high > low, F.floor((F.col("v") - low) / F.when(high > low, high - low).otherwise(1.0) * BINS)).otherwise(0)
    bins = each.groupBy("i", at.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    found = {i: [] for i in range(len(values))}
    for r in sorted(bins.collect(), key=lambda r: r["b"]):  # some thousand bins of a value
        found[r["i"]].append(r)
    return found


def at_rank(rows: DataFrame, values: list[Column], rank: int, around: tuple[float, float] | None = None) -> list[float]:
    """The value of this rank (from 1) of each of the values, none below 0 and all within ``around``: exact, and the same however the rows are dealt.

    Each sweep counts all values in bins and goes on with the bin that the rank falls into, until that holds one value.
    """
    found, ranges, left = {}, around and dict.fromkeys(range(len(values)), around), [rank] * len(values)
    while len(found) < len(values):
        ranges, swept = {}, _sweep(rows, values, ranges)
        for i in set(swept) - set(found):
            for b in swept[i]:
                if left[i] <= b["c"]:
                    break
                left[i] -= b["c"]
            else:
                raise ValueError("values beyond the range of doubles")
            if b["least"] == b["most"]:
                found[i] = b["least"]
            else:
                ranges[i] = (b["least"], b["most"])
    return [found[i] for i in range(len(values))]


class _Points:
    """Rows of a regression, their number and their range; residuals and normal equations of lines over them."""

    def __init__(self, rows: DataFrame, names: list[str]):
        self.rows, self.names = rows, names
        ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{c}") for c in [*names, "y"] for k, f in (("low", F.min), ("high", F.max))]).first()
        self.n = ends["n"]
        if self.n:
            self.box = np.array([[ends[f"low{c}"], ends[f"high{c}"]] for c in names], float)
            self.most = max(abs(ends["lowy"]), abs(ends["highy"]))

    def residual(self, b) -> Column:
        return F.col("y") - sum((F.col(x) * float(v) for x, v in zip(self.names, b)), F.lit(0.0))

    def reach(self, b, c) -> float:
        """The most that a row's residuals of two lines differ, with room for rounding."""
        ends = (np.asarray(b) - c)[:, None] * self.box
        if np.array_equal(b, c):
            return 0.0
        size = self.most + sum((np.abs(v)[:, None] * np.abs(self.box)).max(1).sum() for v in (b, c))
        return max(abs(ends.max(1).sum()), abs(ends.min(1).sum())) + 1e-12 * size

    def products(self, rows: DataFrame, weights: list[Column]) -> np.ndarray:
        """Left and right side of the normal equations of each weight, as weights x p x (p + 1): one aggregate."""
        names = self.names
        sums = rows.agg(*[F.coalesce(F.sum(w * F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{k}{a}{b}") for k, w in enumerate(weights) for i, a in enumerate(names) for b in [*names[i:], "y"]]).first()
        return np.array([[[sums[f"{k}{a}{b}" if i <= j else f"{k}{b}{a}"] for j, b in enumerate([*names, "y"])] for i, a in enumerate(names)] for k in range(len(weights))], float)

    def solved(self, products: np.ndarray) -> np.ndarray | None:
        sound = np.isfinite(products).all() and np.linalg.matrix_rank(products[:, :-1]) == len(self.names)
        found = np.linalg.solve(products[:, :-1], products[:, -1]) if sound else None
        return found if sound and np.isfinite(found).all() else None


class _Band:
    """The rows whose residual of a line is near that of the row last kept, held, and the sums of all rows below them.

    Whom another line keeps is told from these alone, as long as no other row's residual can have crossed its bound: exact, without the rest of the rows.
    """

    def __init__(self, over: _Points, line, rank: int):
        self.over, self.line = over, line
        off = F.abs(over.residual(line))
        (bins,) = _sweep(over.rows, [off]).values()
        upto = np.cumsum([b["c"] for b in bins])
        first, last = (int(np.searchsorted(upto, min(max(r, 1), over.n))) for r in (rank - SIDE * over.n, rank + SIDE * over.n))
        self.rank = rank - int(upto[first] - bins[first]["c"])
        self.low, self.high = bins[first]["least"], bins[last]["most"]
        self.open = first == 0, last == len(bins) - 1
        self.rows = over.rows.filter(off.between(self.low, self.high)).persist()
        (self.sums,) = over.products(over.rows, [(off < self.low).cast("double")])

    def kept(self, line) -> tuple[float, np.ndarray] | None:
        """The greatest residual that ``line`` keeps and the normal equations of the rows kept; None if it lies too far off."""
        moved = self.over.reach(line, self.line)
        low, high = -math.inf if self.open[0] else self.low + moved, math.inf if self.open[1] else self.high - moved
        if not low <= high:
            return None
        off = F.abs(self.over.residual(line))
        (t,) = at_rank(self.rows, [off], self.rank, (max(self.low - moved, 0.0), min(self.high + moved, float(np.finfo(float).max))))
        if not low <= t <= high:
            return None
        (sums,) = self.over.products(self.rows, [(off <= t).cast("double")])
        return t, sums + self.sums


def _drawn(rows: DataFrame, by: list[str], seed: int, most: int, n: int) -> list:
    """The ``most`` different rows of the least hashes: from a slice of the hashes that has many times as many of n different rows, from wider ones if it holds too few."""
    hashed, share = F.xxhash64(F.lit(seed), *by), 64 * most / n
    while True:
        part = rows.filter(hashed < int(share * 2**64) - 2**63) if share < 1 else rows
        drawn = part.distinct().orderBy(hashed, *by).limit(most).collect()
        if len(drawn) == most or share >= 1:
            return drawn
        share *= 64


def high_breakdown(df: DataFrame, xs: list[str], y: str, coverage: float = 0.75, starts: int = 20, screens: int = 3, most_steps: int = 50, most_rounds: int = 50, tolerance: float = 1e-9, seed: int = 0, refine: bool = True) -> RobustLine:
    """Least trimmed squares from many starts, then (``refine``) the efficient line that redescends around it; coefficients with the intercept first.

    Starts are exact fits of rows drawn by hash, ``len(xs) + 1`` rows each; all of them take ``screens`` concentration
    steps together, each a few sweeps for residual bounds and one aggregate of normal equations. The best one goes on until it stays,
    its steps taken on the rows near the last one kept while no other row can have crossed its bound. A step keeps the share ``coverage`` of all rows with the least squared residuals, and all
    that tie with the last of them. Rows with null or non-finite values are left out; the result is the best one seen, not a proven optimum.
    """
    if not 0.5 <= coverage <= 1:
        raise ValueError("coverage lies between 0.5 and 1")
    if starts < 1:
        raise ValueError("at least one start")
    names = [f"x{k}" for k in range(len(xs) + 1)]
    rows = df.select(F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(n) for c, n in zip(xs, names[1:])], F.col(y).cast("double").alias("y")).dropna()
    rows = rows.filter(" and ".join(f"abs({n}) < double('infinity')" for n in [*names, "y"]))
    points = _Points(rows, names)
    p, n, residual = len(names), points.n, points.residual
    if n < p + 1:
        raise ValueError(f"{n} rows of {p + 1} at least")
    rank = max(math.ceil(n * coverage), p + 1)
    drawn = _drawn(rows, [*names, "y"], seed, starts * p, n)
    lines, singular = [], 0
    for k in range(0, len(drawn) - p + 1, p):
        x = np.array([[r[c] for c in names] for r in drawn[k : k + p]])
        start = np.linalg.solve(x, np.array([r["y"] for r in drawn[k : k + p]])) if np.linalg.matrix_rank(x) == p else None
        if start is None or not np.isfinite(start).all():
            singular += 1
        else:
            lines.append(start)
    if not lines:
        raise ValueError("every start is singular")

    def bounded() -> list[tuple[Column, Column]]:
        """The residual of each line, and whether it is kept."""
        r = [residual(b) for b in lines]
        return [(v, F.abs(v) <= t) for v, t in zip(r, at_rank(rows, [F.abs(v) for v in r], rank))]

    for _ in range(screens):
        found = [points.solved(s) for s in points.products(rows, [keep.cast("double") for _, keep in bounded()])]
        singular += sum(b is None for b in found)
        lines = [b for b in found if b is not None] or lines[:1]
    left = rows.agg(*[F.sum(F.when(keep, r**2)).alias(str(k)) for k, (r, keep) in enumerate(bounded())]).first()
    line = lines[int(np.argmin(list(left)))]

    band = _Band(points, line, rank)
    try:
        still, steps = False, 0
        bound, kept = band.kept(line)
        while not still and steps < most_steps and (new := points.solved(kept)) is not None:
            still = bool(np.abs(new - line).max() <= tolerance * max(1.0, np.abs(line).max()))
            line, steps, near = new, steps + 1, band.kept(new)
            if near is None:
                band.rows.unpersist()
                band = _Band(points, line, rank)
                near = band.kept(line)
            bound, kept = near
    finally:
        band.rows.unpersist()
    trimmed, retained = line, int(kept[0, 0])  # x0 is 1 in every row
    scale = _scale(rows.select(residual(line).alias("r")), bound)
    if refine and scale > 0:
        still, steps = False, 0
        while not still and steps < most_rounds:
            u = residual(line) / (LINE_TUNING * scale)
            new = points.solved(points.products(rows, [F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)])[0])
            if new is None:
                break
            still = bool(np.abs(new - line).max() <= tolerance * max(1.0, np.abs(line).max()))
            line, steps = new, steps + 1
    return RobustLine(line.tolist(), trimmed.tolist(), scale, bound, retained, n - retained, steps, still, singular)


def _scale(rows: DataFrame, guess: float) -> float:
    """The scale at which the mean biweight loss of residuals r meets its target; 0 if half of them are 0.

    Each pass tries some scales in one aggregate, the next one more around the place where the curve through them meets the target.
    """
    guess = max(guess, 1e-300)
    tried = guess * 10.0 ** np.array([-12, -6, -3, -1, -0.5, -0.25, 0, 0.25, 0.5, 1, 3, 6])
    while True:
        u = [F.least(F.abs(F.col("r")) / (SCALE_TUNING * float(s)), F.lit(1.0)) for s in tried]
        off, *losses = rows.agg(F.avg((F.col("r") != 0).cast("double")), *[F.avg(1 - (1 - v * v) * (1 - v * v) * (1 - v * v)).alias(str(k)) for k, v in enumerate(u)]).first()
        if off <= SCALE_TARGET:
            return 0.0
        over = np.array(losses) - SCALE_TARGET
        at = int((over > 0).sum())  # the loss falls as the scale grows
        if at in (0, len(tried)):
            return float(tried[0] if at == 0 else tried[-1])
        low, high = tried[at - 1], tried[at]
        if high / low - 1 < 1e-10:
            return float((low + high) / 2)
        near = slice(at - 2, at + 2) if 2 <= at <= len(tried) - 2 and (np.diff(over[at - 2 : at + 2]) < 0).all() else slice(at - 1, at + 1)
        z, f, width = tried[near] / low - 1, over[near], high / low - 1
        root = sum(v * math.prod(f[j] / (f[j] - f[i]) for j in range(len(f)) if j != i) for i, v in enumerate(z))
        if not 0 < root < width:
            root = width / 2
        around = root + np.array([s * max(w * width, 4e-11) for w in (1e-1, 1e-2, 1e-4, 1e-6) for s in (-1, 1)])
        tried = np.unique(low * (1 + np.r_[0, np.sqrt(1 + width) - 1, around[(around > 0) & (around < width)], width]))
        tried[[0, -1]] = low, high
