"""Descriptive, robust and test statistics as aggregate columns or grouped operators.

Aggregates are Spark's own; null values are left out. Quantiles interpolate
linearly between order statistics, which are found exactly without sorting or
holding a group: a mergeable sketch bounds where they lie, and only what lies
there is ranked. ``weighted_median`` and ``ks_uniform`` sort a group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.functions import tails
from heliograin.sources.scratch import beside

CONSISTENT = 1.4826


def guarded(num: Column, den: Column, least: float = 0.0, otherwise: float | None = None) -> Column:
    """num / den, or ``otherwise`` where the denominator's size is ``least`` or less."""
    return F.when(F.abs(den) > least, num / den).otherwise(F.lit(otherwise).cast("double"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.var_samp(v).alias("variance"),
        F.stddev_samp(v).alias("std_dev"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("std_error"),
        F.min(v).alias("min"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.max(v).alias("max"),
    )


#: Share of a group's rows on either side of a rank that are ranked, the sketch's accuracy, and the rows up to which groups are ranked whole.
BAND, ACCURACY, WHOLE = 0.005, 10_000, 1000


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """Rows (keys, n, one column for each name): exact order statistics of each group.

    A rank is told by a fraction and a function of the number of rows n to the rank (from 1), which
    lies within one of fraction * n. A sketch of the group gives bounds around each
    fraction; one aggregate counts what lies below them, and the distinct values inside (about one in a hundred) are ranked with their counts.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    points = sorted({min(max(p + d, 0.0), 1.0) for p, _ in ranks.values() for d in (-BAND, BAND)} | {0.0, 1.0})
    known = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, points)), F.lit(ACCURACY)).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    at = lambda p: F.when(F.col("n") <= WHOLE, F.col("_min") if p < 0.5 else F.col("_max")).otherwise(F.col("_q")[points.index(p)])
    ends = {name: (F.when(F.lit(p <= BAND) | (F.col("n") <= WHOLE), F.col("_min")).otherwise(at(min(max(p - BAND, 0.0), 1.0))), F.when(F.lit(p >= 1 - BAND) | (F.col("n") <= WHOLE), F.col("_max")).otherwise(at(min(max(p + BAND, 0.0), 1.0)))) for name, (p, _) in ranks.items()}
    bands = F.array(*[F.struct(F.lit(j).alias("j"), lo.alias("lo"), hi.alias("hi"), rank(F.col("n")).cast("long").alias("rank")) for j, ((lo, hi), (_, rank)) in enumerate(zip(ends.values(), ranks.values()))])
    known = beside(known.select("_k", "n", bands.alias("_bands")))
    met = rows.join(known, "_k")
    below = met.groupBy("_k").agg(*[F.count_if(F.col("_v") < F.col("_bands")[j]["lo"]).alias(f"_b{j}") for j in range(len(ranks))])
    inside = met.select("_k", "_v", F.explode(F.filter("_bands", lambda x: F.col("_v").between(x["lo"], x["hi"]))).alias("_x"))
    inside = inside.groupBy("_k", F.col("_x.j").alias("_j"), F.col("_x.rank").alias("_rank"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = inside.withColumn("_upto", F.sum("_c").over(W.partitionBy("_k", "_j").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    inside = inside.join(beside(below.select("_k", F.array(*[f"_b{j}" for j in range(len(ranks))]).alias("_below"))), "_k")
    rank = F.col("_rank") - F.get("_below", F.col("_j"))
    hit = inside.filter((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank))
    found = hit.groupBy("_k").agg(*[F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(name) for j, name in enumerate(ranks)])
    return known.select("_k", "n").join(found, "_k").select(*[F.col("_k")[k].alias(k) for k in keys], "n", *ranks)


def _spread(points: list[float]) -> dict[str, tuple[float, Callable[[Column], Column]]]:
    """The two ranks that each point lies between."""
    low = lambda p: lambda n: F.floor((n - 1) * p) + 1
    high = lambda p: lambda n: F.ceil((n - 1) * p) + 1
    return {f"_{side}{k}": (p, f(p)) for k, p in enumerate(points) for side, f in (("lo", low), ("hi", high))}


def _between(k: int, p: float) -> Column:
    place = (F.col("n") - 1) * p
    return F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (place - F.floor(place))


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """One column for each point (clamped to 0..1)."""
    points = [min(1.0, max(0.0, p)) for p in points]
    found = order_statistics(df, keys, value, _spread(points))
    return found.select(*keys, *[_between(k, p).alias(f"q{round(p * 1000):04d}") for k, p in enumerate(points)])


def iqr(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, iqr): the distance of the quartiles."""
    q = quantiles(df, keys, value, [0.25, 0.75])
    return q.select(*keys, (F.col("q0750") - F.col("q0250")).alias("iqr"))


def mad(df: DataFrame, keys: list[str], value: str, consistent: bool = True) -> DataFrame:
    """Median absolute deviation from the group's median: the medians are joined back by key."""
    med = beside(quantiles(df, keys, value, [0.5]).select(F.struct(F.lit(0).alias("_"), *keys).alias("_of"), F.col("q0500").alias("median")))
    off = df.join(med, F.struct(F.lit(0).alias("_"), *keys) == F.col("_of")).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = quantiles(off, [*keys, "median"], "_off", [0.5])
    return spread.select(*keys, "median", (F.col("q0500") * (CONSISTENT if consistent else 1.0)).alias("mad"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Means without, and with clamped, the floor(n * fraction) least and greatest values: two order statistics, then one sum between them."""
    cut = lambda n: F.floor(n * fraction)
    ends = order_statistics(df, keys, value, {"_lo": (fraction, lambda n: cut(n) + 1), "_hi": (1 - fraction, lambda n: n - cut(n))})
    ends = beside(ends.select(F.struct(F.lit(0).alias("_"), *keys).alias("_of"), "n", "_lo", "_hi"))
    met = df.filter(F.col(value).isNotNull()).join(ends, F.struct(F.lit(0).alias("_"), *keys) == F.col("_of"))
    v, lo, hi, k = F.col(value), F.first("_lo"), F.first("_hi"), cut(F.first("n"))
    sums = met.groupBy(*keys).agg(
        F.first("n").alias("_n"), lo.alias("_lo"), hi.alias("_hi"), k.alias("_cut"), F.coalesce(F.sum(F.when((v > F.col("_lo")) & (v < F.col("_hi")), v)), F.lit(0.0)).alias("_s"),
        F.count_if(v <= F.col("_lo")).alias("_low"), F.count_if(v >= F.col("_hi")).alias("_high"),
    )
    # rows at the ends that stay; where both ends are one value all that stay have it
    stay = F.col("_n") - 2 * F.col("_cut")
    inner = F.when(F.col("_lo") == F.col("_hi"), stay * F.col("_lo")).otherwise(F.col("_s") + (F.col("_low") - F.col("_cut")) * F.col("_lo") + (F.col("_high") - F.col("_cut")) * F.col("_hi"))
    return sums.select(*keys, F.when(stay > 0, inner / stay).alias("trimmed_mean"), ((inner + F.col("_cut") * (F.col("_lo") + F.col("_hi"))) / F.col("_n")).alias("winsorized_mean"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """The smallest value whose running weight exceeds half of all; the midpoint with the next one on an exact half."""
    by = W.partitionBy(*keys)
    order = by.orderBy(value, tie)
    r = df.filter(F.col(weight) > 0).select(
        *keys,
        F.col(value).alias("_v"),
        F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_upto"),
        (F.sum(weight).over(by) / 2).alias("_half"),
        F.lead(value).over(order).alias("_next"),
    )
    hit = F.when(F.col("_upto") > F.col("_half"), F.col("_v")).when(F.col("_upto") == F.col("_half"), (F.col("_v") + F.coalesce("_next", "_v")) / 2)
    return r.withColumn("_m", hit).filter("_m is not null").groupBy(*keys).agg(F.min("_m").alias("weighted_median"))


def median_of_means(df: DataFrame, keys: list[str], value: str, id_col: str, blocks: int) -> DataFrame:
    """Median of the means of blocks that the id modulo ``blocks`` deals out: two aggregates."""
    means = df.groupBy(*keys, F.pmod(F.col(id_col), F.lit(blocks)).alias("_block")).agg(F.avg(value).alias("_mean"))
    return means.groupBy(*keys).agg(F.percentile("_mean", F.lit(0.5)).alias("median_of_means"))


def t_test_one_sample(df: DataFrame, keys: list[str], value: str, mean: float, tail: str = "two-sided") -> DataFrame:
    """Student's test of a group's mean; null with fewer than two values."""
    v = F.col(value)
    return df.groupBy(*keys).agg(((F.avg(v) - mean) / (F.stddev_samp(v) / F.sqrt(F.count(v)))).alias("t"), (F.count(v) - 1).alias("dof")).withColumn("p_value", tails.t_tail(F.col("t"), F.col("dof"), tail))


def t_test_two_sample(df: DataFrame, keys: list[str], value: str, in_first: Column, tail: str = "two-sided") -> DataFrame:
    """Pooled and Welch statistics of two samples, in one aggregate."""
    a, b = F.when(in_first, F.col(value)), F.when(~in_first, F.col(value))
    s = df.groupBy(*keys).agg(*[f(x).alias(n + k) for k, x in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2)
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return s.select(
        *keys,
        ((F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t_pooled"),
        (F.col("na") + F.col("nb") - 2).alias("dof_pooled"),
        ((F.col("ma") - F.col("mb")) / F.sqrt(sa + sb)).alias("t_welch"),
        ((sa + sb) * (sa + sb) / (sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1))).alias("dof_welch"),
    ).withColumns({f"p_{k}": tails.t_tail(F.col(f"t_{k}"), F.col(f"dof_{k}"), tail) for k in ("pooled", "welch")})


def one_way_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """F statistic over the groups that have values: per-group sums first, one row from them."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n > 0")
    t = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"),
    )
    between = F.col("squares") - F.col("n") * F.col("grand") * F.col("grand")
    return t.select((F.col("k") - 1).alias("dof_between"), (F.col("n") - F.col("k")).alias("dof_within"), ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f")).withColumn(
        "p_value", tails.f_tail(F.col("f"), F.col("dof_between"), F.col("dof_within"))
    )


def chi_square_uniform(df: DataFrame, category: str) -> DataFrame:
    """Pearson statistic of the category counts against equal shares."""
    c = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return t.select((F.col("s") * F.col("k") / F.col("all") - F.col("all")).alias("chi_square"), (F.col("k") - 1).alias("dof")).withColumn("p_value", tails.chi_square_tail(F.col("chi_square"), F.col("dof")))


def chi_square_poisson(df: DataFrame, value: str, rate: float, bins: int, least_expected: float = 5.0, fitted: int = 0) -> DataFrame:
    """Goodness of fit of counts to the Poisson law of ``rate``: values 0 to bins - 2, and all above as the last bin.

    Neighbouring bins are pooled from the left until each expects ``least_expected``
    rows; a remainder joins the last. One row of ``bins`` counts is all that is pooled; ``fitted``
    parameters lessen the degrees of freedom. Null with fewer than two pooled bins.
    """
    counts = df.filter(F.col(value) >= 0).groupBy(F.least(F.col(value).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))  # one entry for each bin
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 2)), lambda k: F.exp(k * math.log(rate) - rate - ln_factorial(k)))
    row = row.withColumn("shares", shares).withColumn("shares", F.concat("shares", F.array(1 - F.aggregate("shares", F.lit(0.0), lambda a, x: a + x))))
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.struct(F.coalesce(F.element_at("m", k), F.lit(0)).cast("double").alias("o"), (F.col("rows") * F.get("shares", k)).alias("e")))
    open_bin = lambda o, e: F.struct(o.alias("o"), e.alias("e"))
    start = F.struct(F.array().cast("array<struct<o:double,e:double>>").alias("done"), open_bin(F.lit(0.0), F.lit(0.0)).alias("now"))

    def pooled(s, x):
        o, e = s["now"]["o"] + x["o"], s["now"]["e"] + x["e"]
        full = e >= max(least_expected, 1e-12)
        none = open_bin(F.lit(0.0), F.lit(0.0))
        return F.struct(F.when(full, F.concat(s["done"], F.array(open_bin(o, e)))).otherwise(s["done"]).alias("done"), F.when(full, none).otherwise(open_bin(o, e)).alias("now"))

    row = row.select(F.aggregate(each, start, pooled).alias("s"))
    last = F.element_at("s.done", -1)
    joined = F.concat(F.slice("s.done", F.lit(1), F.size("s.done") - 1), F.array(open_bin(last["o"] + F.col("s.now.o"), last["e"] + F.col("s.now.e"))))
    row = row.filter("size(s.done) >= 2").select(joined.alias("bins"))
    stat = F.aggregate("bins", F.lit(0.0), lambda a, x: a + (x["o"] - x["e"]) * (x["o"] - x["e"]) / x["e"])
    made = row.select(stat.alias("chi_square"), (F.size("bins") - 1 - fitted).cast("long").alias("dof"))
    return made.withColumn("p_value", tails.chi_square_tail(F.col("chi_square"), F.col("dof")))


#: Parts of the interval whose distinct values one task puts in order.
KS_PARTS = 1024


def ks_uniform(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance to the uniform law on [low, high].

    Equal values count once with their number; parts of the interval are put in order side by side, each from the count of what lies before it.
    """
    p = F.least(F.greatest((F.col(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *keys).alias("_k"), p.alias("_p"))
    each = rows.groupBy("_k", F.floor(F.col("_p") * KS_PARTS).alias("_b"), "_p").agg(F.count(F.lit(1)).alias("_c"))
    parts = each.groupBy("_k", "_b").agg(F.sum("_c").alias("_in"))  # KS_PARTS + 1 rows of a group at most
    before = F.coalesce(F.sum("_in").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_k", "_b", before.alias("_before"), F.sum("_in").over(W.partitionBy("_k")).alias("_n"))
    upto = F.sum("_c").over(W.partitionBy("_k", "_b").orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    r = each.withColumn("_upto", upto).join(parts, ["_k", "_b"]).withColumn("_i", F.col("_before") + F.col("_upto"))
    d = F.max(F.greatest(F.col("_i") / F.col("_n") - F.col("_p"), F.col("_p") - (F.col("_i") - F.col("_c")) / F.col("_n")))
    found = r.groupBy("_k").agg(d.alias("d"), F.first("_n").alias("n")).select(*[F.col("_k")[k].alias(k) for k in keys], "d", "n")
    return found.withColumn("p_value", tails.kolmogorov_tail(F.col("d"), F.col("n")))


def linear_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line and R2; (0, 0) with fewer than two rows, slope 0 where x doesn't vary."""
    a = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    )
    slope = F.when((F.col("n") >= 2) & (F.col("vx") > 1e-12), F.col("c") / F.col("vx")).otherwise(0.0)
    return a.select(
        *keys, slope.alias("slope"), F.when(F.col("n") >= 2, F.col("my") - slope * F.col("mx")).otherwise(0.0).alias("intercept"),
        F.when((F.col("vx") > 1e-12) & (F.col("vy") > 1e-12), F.col("c") * F.col("c") / (F.col("vx") * F.col("vy"))).alias("r2"),
    )


def polynomial_sums(df: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """One row with the power sums of the normal equations of a polynomial fit: s0.. and t0.."""
    power = lambda k: F.pow(F.col(x), F.lit(float(k)))
    return df.agg(*[F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(power(k) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)])


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients from the constant up; the data are reduced to 3 * degree + 2 sums before they are solved."""
    import numpy as np

    s = polynomial_sums(df, x, y, degree).first()
    a = np.array([[s[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(a, np.array([s[f"t{i}"] for i in range(degree + 1)])).tolist()


def allan_deviation(df: DataFrame, keys: list[str], order: list[str], value: str, m: int) -> DataFrame:
    """Allan deviation at averaging factor m over whole, not overlapping blocks of a series."""
    numbered = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    blocks = numbered.groupBy(*keys, F.floor(F.col("_i") / m).alias("_b")).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == m)
    step = blocks.withColumn("_d", F.col("_mean") - F.lag("_mean").over(W.partitionBy(*keys).orderBy("_b")))
    return step.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d")) / (2 * F.count("_d"))).alias("allan_deviation"), F.count("_d").alias("n"))


def effective_dof(df: DataFrame, keys: list[str], u: str, dof: str) -> DataFrame:
    """Welch-Satterthwaite: combined standard uncertainty and effective degrees of freedom of components."""
    s = F.sum(F.col(u) * F.col(u))
    return df.groupBy(*keys).agg(F.sqrt(s).alias("combined"), (s * s / F.sum(F.pow(F.col(u), F.lit(4.0)) / F.col(dof))).alias("effective_dof"))


def ln_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series above 20, by a sum of logarithms up to there."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(0), F.least(n.cast("int"), F.lit(20))), F.lit(0.0), lambda acc, k: acc + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0))
    large = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, small).otherwise(large)


def ln_binomial(n: Column, k: Column) -> Column:
    return F.when((k >= 0) & (k <= n), ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k))
