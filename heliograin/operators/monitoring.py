"""Condition and model monitoring: zones, remaining life, multivariate charts, drift and comparison rules."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.operators.flows import rarity

# Vibration zone bounds in mm/s by machine group and support.
ZONES = {(1, "rigid"): (2.3, 4.5, 7.1), (1, "flexible"): (3.5, 7.1, 11.0), (2, "rigid"): (1.4, 2.8, 4.5), (2, "flexible"): (2.3, 4.5, 7.1)}
# Control-chart constants by subgroup size: d2, d3, c4.
CHART = {2: (1.128, 0.853, 0.7979), 3: (1.693, 0.888, 0.8862), 4: (2.059, 0.880, 0.9213), 5: (2.326, 0.864, 0.9400), 6: (2.534, 0.848, 0.9515), 7: (2.704, 0.833, 0.9594), 8: (2.847, 0.820, 0.9650), 9: (2.970, 0.808, 0.9693), 10: (3.078, 0.797, 0.9727)}


def vibration_zone(rms: Column, group: int, support: str) -> Column:
    a, b, c = ZONES[group, support]
    return F.when(rms < a, "A").when(rms < b, "B").when(rms < c, "C").otherwise("D")


def remaining_life(df: DataFrame, keys: list[str], order: list[str], time: str, health: str, window: int, most: float = 100_000.0) -> DataFrame:
    """``df`` with rul: time until a least-squares line over the trailing window reaches 0; ``most`` where it doesn't fall."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0)
    n, v = F.count(F.lit(1)).over(w), F.var_pop(time).over(w)
    slope = F.when(v > 0, F.covar_pop(time, health).over(w) / v)
    d = df.withColumns({"_n": n, "_s": slope, "_a": F.avg(health).over(w) - slope * F.avg(time).over(w)})
    rul = F.when(F.col("_s").isNull() | (F.col("_s") >= 0), most).otherwise(F.greatest(-F.col("_a") / F.col("_s") - F.col(time), F.lit(0.0)))
    return d.withColumn("rul", F.when(F.col("_n") >= 2, rul)).drop("_n", "_s", "_a")


def hotelling(train: DataFrame, rows: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """``rows`` with t2, the Mahalanobis distance squared, and out = t2 > limit.

    Means and covariances are one aggregate; the small matrix is inverted on the driver and goes back as literals.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    a = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.array([[a[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    if np.linalg.matrix_rank(cov) < len(columns):
        raise ValueError("the covariance is singular")
    inv = np.linalg.inv(cov)
    off = [F.col(c) - F.lit(a[f"m{i}"]) for i, c in enumerate(columns)]
    t2 = F.lit(0.0)
    for i in range(len(columns)):
        for j in range(len(columns)):
            t2 = t2 + off[i] * off[j] * F.lit(float(inv[i, j]))
    return rows.withColumn("t2", t2).withColumn("out", F.col("t2") > limit)


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[list[float], np.ndarray]:
    """Means and the k leading eigenvectors of the covariance of the columns, from one aggregate row."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    a = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.array([[a[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
    values, vectors = np.linalg.eigh(cov)
    return [a[f"m{i}"] for i in range(len(columns))], vectors[:, np.argsort(-values)[:k]]


def residual_error(df: DataFrame, columns: list[str], model: tuple[list[float], np.ndarray]) -> DataFrame:
    """``df`` with spe: the squared distance to the plane of the components."""
    means, v = model
    off = [F.col(c) - F.lit(m) for c, m in zip(columns, means)]
    scores = [sum((off[i] * F.lit(float(v[i, k])) for i in range(len(columns))), F.lit(0.0)) for k in range(v.shape[1])]
    return df.withColumn("spe", sum((o * o for o in off), F.lit(0.0)) - sum((s * s for s in scores), F.lit(0.0)))


def control_limits(df: DataFrame, subgroup: list[str], value: str, size: int) -> DataFrame:
    """One row with the limits of mean and range charts over whole subgroups of ``size`` values."""
    d2, d3, _ = CHART[size]
    g = df.groupBy(*subgroup).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.max(value) - F.min(value)).alias("r")).filter(F.col("n") == size)
    a = g.agg(F.avg("m").alias("centre"), F.avg("r").alias("range"))
    a2, low, high = 3 / (d2 * size**0.5), max(0.0, 1 - 3 * d3 / d2), 1 + 3 * d3 / d2
    return a.select("centre", (F.col("centre") - a2 * F.col("range")).alias("mean_low"), (F.col("centre") + a2 * F.col("range")).alias("mean_high"), (low * F.col("range")).alias("range_low"), (high * F.col("range")).alias("range_high"))


def model_drift(df: DataFrame, window: Column, actual: str, predicted: str, baseline: float, factor: float) -> DataFrame:
    """Windows with their mean absolute error over the baseline's, flagged beyond ``factor``."""
    e = df.groupBy(window.alias("window")).agg((F.avg(F.abs(F.col(actual) - F.col(predicted))) / baseline).alias("ratio"))
    return e.withColumn("drift", F.col("ratio") > factor)


def shadow_decision(df: DataFrame, actual: str, current: str, candidate: str, margin: float, least: int) -> DataFrame:
    """One row: mean absolute errors of two models and promote, keep or inconclusive."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(actual) - F.col(current))).alias("current"), F.avg(F.abs(F.col(actual) - F.col(candidate))).alias("candidate"))
    rule = F.when(F.col("n") < least, "inconclusive").when(F.col("candidate") < F.col("current") * (1 - margin), "promote").when(F.col("candidate") > F.col("current") * (1 + margin), "keep").otherwise("inconclusive")
    return a.withColumn("decision", rule)


def partial_correlation(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    r = df.agg(F.corr(a, b).alias("ab"), F.corr(a, given).alias("ac"), F.corr(b, given).alias("bc"), F.count(F.lit(1)).alias("n"))
    return r.select(((F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc")))).alias("partial_correlation"), "n")


def miner_damage(cycles: DataFrame, keys: list[str], stress: str, count: str, at_one: float, exponent: float) -> DataFrame:
    """Sums of cycles over Basquin lives at_one * stress ** -exponent."""
    return cycles.groupBy(*keys).agg(F.sum(F.col(count) * F.pow(F.col(stress), F.lit(exponent)) / at_one).alias("damage"))


def bearing_frequencies(shaft: Column, balls: int, ball: float, pitch: float, angle: float = 0.0) -> dict[str, Column]:
    import math

    r = ball / pitch * math.cos(angle)
    return {"bpfo": shaft * (balls / 2 * (1 - r)), "bpfi": shaft * (balls / 2 * (1 + r)), "bsf": shaft * (pitch / (2 * ball) * (1 - r * r)), "ftf": shaft * ((1 - r) / 2)}


def lomb_scargle(df: DataFrame, keys: list[str], time: str, value: str, frequencies: list[float]) -> DataFrame:
    """Rows (keys, frequency, power) of unevenly sampled series at stated frequencies, as two aggregates of sums."""
    import math

    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    each = df.join(mean, keys).filter("_v > 0").select(*keys, (F.col(value) - F.col("_m")).alias("_y"), F.col(time).alias("_t"), "_v", F.explode(F.array(*map(F.lit, frequencies))).alias("frequency"))
    w = 2 * math.pi * F.col("frequency")
    tau = each.groupBy(*keys, "frequency").agg((F.atan2(F.sum(F.sin(2 * w * F.col("_t"))), F.sum(F.cos(2 * w * F.col("_t")))) / 2).alias("_p"))
    at = w * F.col("_t") - F.col("_p")
    c, s = F.cos(at), F.sin(at)
    power = (F.pow(F.sum(F.col("_y") * c), F.lit(2.0)) / F.sum(c * c) + F.pow(F.sum(F.col("_y") * s), F.lit(2.0)) / F.sum(s * s)) / (2 * F.first("_v"))
    return each.join(tau, [*keys, "frequency"]).groupBy(*keys, "frequency").agg(power.alias("power"))


def crossing_strategy(df: DataFrame, keys: list[str], order: list[str], price: str, fast: int, slow: int) -> DataFrame:
    """``df`` with position (sign of fast minus slow mean) and pnl: the position of the row before times the price change."""
    s = W.partitionBy(*keys).orderBy(*order)
    mean = lambda n: F.avg(price).over(s.rowsBetween(1 - n, 0))
    full = F.count(F.lit(1)).over(s.rowsBetween(1 - slow, 0)) == slow
    d = df.withColumn("position", F.when(full, F.signum(mean(fast) - mean(slow))).otherwise(0.0))
    return d.withColumn("pnl", F.coalesce(F.lag("position").over(s) * (F.col(price) - F.lag(price).over(s)), F.lit(0.0)))


def payload_protocol(payload: Column) -> Column:
    """Protocol by the first characters of a payload."""
    rules = [("http", "^(GET|POST|PUT|HEAD|DELETE|OPTIONS|HTTP/)"), ("ssh", "^SSH-"), ("smtp", "^(EHLO|HELO|220 )"), ("ftp", "^(USER|PASS|230 )"), ("tls", "^\\x16\\x03")]
    out = None
    for name, pattern in rules:
        out = F.when(payload.rlike(pattern), name) if out is None else out.when(payload.rlike(pattern), name)
    return out.otherwise("unknown")


def rollbacks(df: DataFrame, keys: list[str], order: list[str], hit: str, window: int, floor: float, least: int) -> DataFrame:
    """``df`` with coverage, the share of hits in the last ``window`` rows of a series, and rollback, 1 from the first row on
    where coverage falls below the floor (after ``least`` rows); the windowed form of the kernel that streams use. Rows without a hit value are left out."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.filter(F.col(hit).isNotNull()).withColumns({"coverage": F.avg(hit).over(w.rowsBetween(1 - window, 0)), "_n": F.row_number().over(w)})
    low = ((F.col("_n") >= F.lit(least)) & (F.col("coverage") < floor)).cast("double")
    return rows.withColumn("rollback", F.max(low).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_n")


def market_scan(candles: DataFrame, symbol: str, order: list[str], price: str, strategies: list[tuple[int, int]], least_return: float = 0.0, most_drawdown: float = 1.0, least_trades: int = 1) -> DataFrame:
    """Rows (symbol, fast, slow, total_return, max_drawdown, trades, score, proof): crossing strategies of each symbol that meet the constraints.

    Returns and drawdowns are of an equity that starts at the first price. The score weighs return against drawdown;
    the proof is the SHA-256 of the other columns, so a row can be verified.
    """
    found = []
    s = W.partitionBy(symbol).orderBy(*order)
    for fast, slow in strategies:
        r = crossing_strategy(candles, [symbol], order, price, fast, slow)
        r = r.withColumns({"_first": F.first(price).over(s), "_equity": F.first(price).over(s) + F.sum("pnl").over(s), "_turn": (F.col("position") != F.coalesce(F.lag("position").over(s), F.lit(0.0))).cast("int")})
        r = r.withColumn("_peak", F.max("_equity").over(s.rowsBetween(W.unboundedPreceding, 0)))
        found.append(
            r.groupBy(symbol).agg(
                F.lit(fast).alias("fast"), F.lit(slow).alias("slow"), (F.sum("pnl") / F.first("_first")).alias("total_return"),
                F.max((F.col("_peak") - F.col("_equity")) / F.col("_peak")).alias("max_drawdown"), F.sum("_turn").alias("trades"),
            )
        )
    all_of = reduce(DataFrame.unionByName, found).filter((F.col("total_return") >= least_return) & (F.col("max_drawdown") <= most_drawdown) & (F.col("trades") >= least_trades))
    scored = all_of.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("total_return") / 2 - F.col("max_drawdown") / 2)))
    return scored.withColumn("proof", scan_proof(symbol))


def scan_proof(symbol: str) -> Column:
    """The digest of a scan's row; equal to its proof unless the row was changed."""
    fixed = lambda c: F.round(F.col(c) * 1e6).cast("long").cast("string")
    return F.sha2(F.concat_ws("|", F.col(symbol), F.col("fast").cast("string"), F.col("slow").cast("string"), fixed("total_return"), fixed("max_drawdown"), F.col("trades").cast("string"), fixed("score")), 256)


def baseline_alarms(learn: DataFrame, calibrate: DataFrame, rows: DataFrame, key: str, seen: str, quantile: float, unseen: float = 8.0) -> DataFrame:
    """``rows`` with score and alarm: rarity of the key (a function code, say) and of the address against a learned baseline, over
    the calibration rows' quantile of scores. The bound is one broadcast row."""
    bound = rarity(learn, calibrate, key, seen, unseen).agg(F.percentile("score", F.lit(quantile)).alias("_bound"))
    scored = rarity(learn, rows, key, seen, unseen).crossJoin(F.broadcast(bound))
    return scored.withColumn("alarm", F.col("score") > F.col("_bound") + 1e-9).drop("_bound")
