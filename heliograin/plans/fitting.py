"""Queries of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import fitting
from heliograin.plans.base import EVENTS, events, query, rounded, table


@query(
    f"WITH {EVENTS}, o AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS x, avg(value) OVER (PARTITION BY user_id) AS m, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events_t), "
    "l AS (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i)), r AS (SELECT user_id, any_value(n) AS n, any_value(m) AS m, sum(x * x1) / sum(x * x) AS a, sum(x * x2) / sum(x * x) AS b, max(value) FILTER (i = n) AS v1, max(value) FILTER (i = n - 1) AS v2 FROM l WHERE n > 2 GROUP BY ALL), "
    "p AS (SELECT *, a * (1 - b) / (1 - a * a) AS p1, (b - a * a) / (1 - a * a) AS p2 FROM r), f AS (SELECT *, m * (1 - p1 - p2) AS c, m * (1 - p1 - p2) + p1 * v1 + p2 * v2 AS f1 FROM p) "
    "SELECT user_id, n, round(c, 6) AS intercept, round(p1, 6) AS phi_1, round(p2, 6) AS phi_2, round(f1, 6) AS forecast_1, round(c + p1 * f1 + p2 * v1, 6) AS forecast_2 FROM f"
)
def fitting_autoregression(spark, d):
    return rounded(fitting.autoregression(events(spark, d), ["user_id"], ["t", "event_id"], "value", 2, 2), 6)


ROUNDS = 12


def _rounds() -> str:
    parts = ["q0 AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)"]
    for k in range(1, ROUNDS):
        parts.append(
            f"q{k} AS MATERIALIZED (SELECT (sy - b * sx) / s AS a, b FROM (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b FROM (SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM "
            f"(SELECT l_quantity AS x, l_extendedprice AS y, CASE WHEN l_extendedprice - a - b * l_quantity >= 0 THEN 0.9 ELSE 0.1 END::DOUBLE / greatest(abs(l_extendedprice - a - b * l_quantity), 500) AS w FROM lineitem, q{k - 1}))))"
        )
    return ", ".join(parts)


@query(f"WITH {_rounds()} SELECT round(a, 2) AS intercept, round(b, 2) AS slope, round(avg((y - a - b * x) * CASE WHEN y - a - b * x >= 0 THEN 0.9 ELSE -0.1 END), 2) AS loss FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), q{ROUNDS - 1} GROUP BY a, b")
def fitting_quantile_regression(spark, d):
    li = table(spark, d, "lineitem")
    a, b = fitting.quantile_regression(li, ["l_quantity"], "l_extendedprice", 0.9, ROUNDS, 0.0, 500.0)
    loss = F.avg(fitting.pinball(F.col("l_extendedprice") - a - b * F.col("l_quantity"), 0.9))
    return rounded(li.agg(F.lit(a).alias("intercept"), F.lit(b).alias("slope"), loss.alias("loss")), 2)


@query("SELECT p_partkey, round(p_size * p_retailprice / (p_size + 10) + 1e-7, 5) AS value, round(sqrt((p_retailprice * 10 / (p_size + 10) ** 2 / 3) ** 2 + (p_size / (p_size + 10) * 0.01 * p_retailprice) ** 2) + 1e-7, 5) AS uncertainty FROM part")
def fitting_uncertainty(spark, d):
    p = table(spark, d, "part")
    x, f = [F.col("p_size").cast("double"), F.col("p_retailprice")], lambda a, b: a * b / (a + 10)
    return rounded(p.select("p_partkey", (f(*x) + 1e-7).alias("value"), (fitting.combined_uncertainty(f, x, [F.lit(1 / 3), 0.01 * F.col("p_retailprice")]) + 1e-7).alias("uncertainty")), 5)


def _one_sided(d: str) -> str:
    """SQL of the one-sided run length under a shift of k + ``d``."""
    x = f"(2 * ({d}) * 5.166::DOUBLE)"
    near = " * (1 - ".join(["1", *[f"{x} / {k}" for k in range(3, 9)]]).replace("1 * (1 - ", "(1 - ", 1) + ")" * 6
    return f"CASE WHEN abs({x}) < 0.1 THEN 5.166::DOUBLE * 5.166::DOUBLE * {near} ELSE (exp(-{x}) + {x} - 1) / (2 * ({d}) * ({d})) END"


@query(f"WITH s AS (SELECT s_suppkey, s_acctbal / 5000 AS s FROM supplier) SELECT s_suppkey, round(1 / (1 / ({_one_sided('s - 0.5')}) + 1 / ({_one_sided('-s - 0.5')})), 4) AS run_length FROM s")
def fitting_run_length(spark, d):
    return rounded(table(spark, d, "supplier").select("s_suppkey", fitting.run_length(F.col("s_acctbal") / 5000, 0.5, 4.0).alias("run_length")))


@query()
def fitting_high_breakdown(spark, d):
    """The price by quantity that most line items follow, however far the rest lie, and how many it leaves out."""
    found = fitting.high_breakdown(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", starts=6, screens=2, tolerance=1e-5)
    a, b = found.coefficients
    rows = spark.createDataFrame([(a, b, found.scale, found.retained, found.rejected, found.converged)], "intercept double, slope double, scale double, retained long, rejected long, converged boolean")
    return rounded(rows, 2)
