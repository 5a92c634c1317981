"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.functions import stats
from heliograin.plans.base import EVENTS, events, query, rounded, table

KEYS = ["l_returnflag"]


# independent forms of the tails: densities with their gamma constants, Simpson's rule from the statistic on
GRID = "(SELECT unnest(range(0, 2001)) AS k)"
WEIGHT = "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"


def t_sql(rows: str, t: str, dof: str, name: str) -> str:
    """SQL part ``name``: the rows with their two-sided p, over the angle from atan(|t| / sqrt(dof)) on."""
    a, h = f"atan(abs({t}) / sqrt({dof}))", f"(least(pi() / 2, atan(abs({t}) / sqrt({dof})) + 14 / sqrt({dof})) - atan(abs({t}) / sqrt({dof}))) / 2000"
    constant = f"2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi())"
    return f"{name} AS (SELECT {rows}.*, p.p FROM {rows}, LATERAL (SELECT {constant} * sum({WEIGHT} * greatest(cos({a} + k * {h}), 0) ** ({dof} - 1)) * {h} / 3 AS p FROM {GRID}) p)"


@query(
    "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 2) AS variance, round(stddev_samp(o_totalprice), 4) AS std_dev, "
    "round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4) AS std_error, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.5), 4) AS median, max(o_totalprice) AS max FROM orders GROUP BY ALL"
)
def stats_describe(spark, d):
    r = stats.describe(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return rounded(r.withColumn("variance", F.round("variance", 2)))


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS q{round(p * 1000):04d}" for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)) + " FROM lineitem GROUP BY ALL")
def stats_quantiles(spark, d):
    return rounded(stats.quantiles(table(spark, d, "lineitem"), KEYS, "l_extendedprice", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr FROM lineitem GROUP BY ALL")
def stats_iqr(spark, d):
    return rounded(stats.iqr(table(spark, d, "lineitem"), KEYS, "l_extendedprice"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS median, round(mad(l_extendedprice) * 1.4826, 4) AS mad FROM lineitem GROUP BY ALL")
def stats_mad(spark, d):
    return rounded(stats.mad(table(spark, d, "lineitem"), KEYS, "l_extendedprice"))


@query(
    "WITH r AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), "
    "b AS (SELECT *, floor(n * 0.1) AS k, i BETWEEN floor(n * 0.1) + 1 AND n - floor(n * 0.1) AS inside FROM r) SELECT l_returnflag, round(avg(v) FILTER (inside), 4) AS trimmed_mean, "
    "round((sum(v) FILTER (inside) + max(k) * (min(v) FILTER (inside) + max(v) FILTER (inside))) / count(*), 4) AS winsorized_mean FROM b GROUP BY ALL"
)
def stats_trimmed_mean(spark, d):
    return rounded(stats.trimmed_mean(table(spark, d, "lineitem"), KEYS, "l_extendedprice", 0.1))


@query(
    "WITH r AS (SELECT c_mktsegment, c_acctbal AS v, sum(c_custkey) OVER w AS upto, sum(c_custkey) OVER (PARTITION BY c_mktsegment) / 2 AS half, lead(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS nxt "
    "FROM customer WHERE c_custkey > 0 WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING)) "
    "SELECT c_mktsegment, round(min(CASE WHEN upto > half THEN v WHEN upto = half THEN (v + coalesce(nxt, v)) / 2 END), 4) AS weighted_median FROM r GROUP BY ALL"
)
def stats_weighted_median(spark, d):
    return rounded(stats.weighted_median(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey", "c_custkey"))


@query("WITH m AS (SELECT o_orderpriority, o_orderkey % 9 AS b, avg(o_totalprice) AS m FROM orders GROUP BY ALL) SELECT o_orderpriority, round(median(m), 7) AS median_of_means FROM m GROUP BY ALL")
def stats_median_of_means(spark, d):
    return rounded(stats.median_of_means(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 9), 7)


@query(
    "WITH s AS (SELECT o_orderpriority, (avg(o_totalprice) - 145000) / (stddev_samp(o_totalprice) / sqrt(count(*))) AS t, count(*) - 1 AS dof FROM orders GROUP BY ALL), "
    + t_sql("s", "t", "dof", "q")
    + " SELECT o_orderpriority, round(t, 4) AS t, dof, round(p, 4) AS p_value FROM q"
)
def stats_t_test_one_sample(spark, d):
    return rounded(stats.t_test_one_sample(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 145000.0))


@query(
    "WITH s AS (SELECT l_linestatus, avg(l_quantity) FILTER (l_returnflag = 'R') AS ma, avg(l_quantity) FILTER (l_returnflag <> 'R') AS mb, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS va, "
    "var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS vb, count(*) FILTER (l_returnflag = 'R') AS na, count(*) FILTER (l_returnflag <> 'R') AS nb FROM lineitem GROUP BY ALL), "
    "u AS (SELECT l_linestatus, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t_pooled, na + nb - 2 AS dof_pooled, (ma - mb) / sqrt(va / na + vb / nb) AS t_welch, "
    "(va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS dof_welch FROM s), "
    + t_sql("u", "t_pooled", "dof_pooled", "x") + ", " + t_sql("u", "t_welch", "dof_welch", "y")
    + " SELECT l_linestatus, round(x.t_pooled, 4) AS t_pooled, x.dof_pooled, round(x.t_welch, 4) AS t_welch, round(x.dof_welch, 4) AS dof_welch, round(x.p, 4) AS p_pooled, round(y.p, 4) AS p_welch FROM x JOIN y USING (l_linestatus)"
)
def stats_t_test_two_sample(spark, d):
    return rounded(stats.t_test_two_sample(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "R"))


@query(
    "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY ALL), a AS (SELECT avg(o_totalprice) AS grand FROM orders), "
    "t AS (SELECT count(*) - 1 AS b, sum(n)::BIGINT - count(*) AS w, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM g, a), "
    "z AS (SELECT *, sqrt(b * f / w) AS z, 14 / sqrt(w) / 2000 AS h FROM t) "
    f"SELECT b AS dof_between, w AS dof_within, round(any_value(f), 4) AS f, round(any_value(2 * exp(lgamma((b + w) / 2.0) - lgamma(b / 2.0) - lgamma(w / 2.0)) * h / 3) * sum({WEIGHT} * exp((b - 1) * ln(z + k * h) - (b + w) / 2.0 * ln(1 + (z + k * h) ** 2))), 4) AS p_value FROM z, {GRID} GROUP BY ALL"
)
def stats_anova(spark, d):
    return rounded(stats.one_way_anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


def chi_square_sql(rows: str) -> str:
    """SQL of the result with its tail, of one row (x, dof)."""
    return (
        f"SELECT round(any_value(x), 4) AS chi_square, dof, round(any_value(exp(-(dof / 2.0 - 1) * ln(2.0) - lgamma(dof / 2.0)) * 14 / 2000 / 3) * sum({WEIGHT} * exp((dof - 1) * ln(sqrt(x) + k * 14.0::DOUBLE / 2000) - (sqrt(x) + k * 14.0::DOUBLE / 2000) ** 2 / 2)), 4) AS p_value FROM {rows}, {GRID} GROUP BY ALL"
    )


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT sum((n - e) ** 2 / e) AS x, count(*) - 1 AS dof FROM c, (SELECT sum(n) / count(*) AS e FROM c)) " + chi_square_sql("r"))
def stats_chi_square(spark, d):
    return rounded(stats.chi_square_uniform(table(spark, d, "events"), "event_type"))


@query(
    "WITH RECURSIVE c AS (SELECT count(*) FILTER (n = k) AS o, k FROM (SELECT least(l_linenumber, 9) AS n FROM lineitem), (SELECT unnest(range(0, 10)) AS k) GROUP BY ALL), t AS (SELECT sum(o) AS n FROM c), p AS (SELECT k, exp(k * ln(3.0) - 3.0 - lgamma(k + 1)) AS p FROM c WHERE k < 9), "
    "e AS (SELECT k, o, n * CASE WHEN k < 9 THEN p ELSE 1 - (SELECT sum(p) FROM p) END AS e FROM c LEFT JOIN p USING (k), t), w AS (SELECT 0 AS k, o::DOUBLE AS o, e, 0 AS g FROM e WHERE k = 0 UNION ALL SELECT e.k, CASE WHEN w.e >= 5 THEN e.o ELSE w.o + e.o END, CASE WHEN w.e >= 5 THEN e.e ELSE w.e + e.e END, CASE WHEN w.e >= 5 THEN g + 1 ELSE g END FROM w JOIN e ON e.k = w.k + 1), "
    "l AS (SELECT g, arg_max(o, k) AS o, arg_max(e, k) AS e FROM w GROUP BY ALL), m AS (SELECT max(g) FILTER (e >= 5) AS m FROM l), b AS (SELECT least(g, m) AS g, sum(o) AS o, sum(e) AS e FROM l, m GROUP BY ALL), r AS (SELECT sum((o - e) ** 2 / e) AS x, count(*) - 1 AS dof FROM b) "
    + chi_square_sql("r")
)
def stats_chi_square_poisson(spark, d):
    return rounded(stats.chi_square_poisson(table(spark, d, "lineitem"), "l_linenumber", 3.0, 10))


@query(
    "WITH r AS (SELECT l_returnflag, l_discount AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), "
    "p AS (SELECT *, least(greatest(v / 0.1, 0), 1) AS p FROM r), k AS (SELECT l_returnflag, max(greatest(i / n - p, p - (i - 1) / n)) AS d, any_value(n) AS n FROM p GROUP BY ALL) "
    "SELECT l_returnflag, round(d, 4) AS d, n, round(least(greatest(list_sum(list_transform(range(1, 101), lambda j: 2 * (-1) ** (j - 1) * exp(-2 * j * j * ((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d) ** 2))), 0), 1), 4) AS p_value FROM k"
)
def stats_ks(spark, d):
    return rounded(stats.ks_uniform(table(spark, d, "lineitem"), KEYS, "l_discount", 0.0, 0.1))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY ALL")
def stats_linear_regression(spark, d):
    return rounded(stats.linear_regression(table(spark, d, "lineitem"), KEYS, "l_quantity", "l_extendedprice"))


@query("SELECT count(*)::DOUBLE AS s0, sum(p_size::DOUBLE) AS s1, sum(p_size::DOUBLE ** 2) AS s2, sum(p_size::DOUBLE ** 3) AS s3, sum(p_size::DOUBLE ** 4) AS s4, round(sum(p_retailprice), 2) AS t0, round(sum(p_size * p_retailprice), 2) AS t1, round(sum(p_size::DOUBLE ** 2 * p_retailprice), 2) AS t2 FROM part")
def stats_polynomial_sums(spark, d):
    return rounded(stats.polynomial_sums(table(spark, d, "part"), "p_size", "p_retailprice", 2), 2)


@query(
    f"WITH {EVENTS}, i AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM events_t), b AS (SELECT user_id, i // 4 AS b, avg(value) AS m, count(*) AS n FROM i GROUP BY ALL HAVING n = 4), "
    "s AS (SELECT user_id, m - lag(m) OVER (PARTITION BY user_id ORDER BY b) AS d FROM b) SELECT user_id, CASE WHEN count(d) > 0 THEN round(sqrt(sum(d * d) / (2 * count(d))), 4) END AS allan_deviation, count(d) AS n FROM s GROUP BY ALL"
)
def stats_allan_deviation(spark, d):
    r = stats.allan_deviation(events(spark, d), ["user_id"], ["t", "event_id"], "value", 4)
    return rounded(r)


@query(
    "SELECT s_nationkey, round(sqrt(sum(s_acctbal ** 2)), 4) AS combined, round(sum(s_acctbal ** 2) ** 2 / sum(s_acctbal ** 4 / (s_suppkey + 1)), 4) AS effective_dof FROM supplier GROUP BY ALL"
)
def stats_effective_dof(spark, d):
    return rounded(stats.effective_dof(table(spark, d, "supplier").withColumn("dof", F.col("s_suppkey") + 1), ["s_nationkey"], "s_acctbal", "dof"))


@query("SELECT p_partkey, round(lgamma(p_size + 1), 4) AS ln_factorial, round(lgamma(p_size + 1) - lgamma(p_size // 3 + 1) - lgamma(p_size - p_size // 3 + 1), 4) AS ln_binomial FROM part")
def stats_combinatorics(spark, d):
    n, k = F.col("p_size"), F.floor(F.col("p_size") / 3).cast("int")
    return rounded(table(spark, d, "part").select("p_partkey", stats.ln_factorial(n).alias("ln_factorial"), stats.ln_binomial(n, k).alias("ln_binomial")))
