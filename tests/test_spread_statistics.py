"""Order statistics and the Kolmogorov-Smirnov distance without a group in one task."""

import numpy as np

from heliograin.functions import stats


def test_rows_stay_where_they_are(spark, data):
    li = spark.read.parquet(f"{data}/lineitem.parquet")
    for found in (stats.iqr(li, ["l_returnflag"], "l_extendedprice"), stats.mad(li, ["l_returnflag"], "l_extendedprice"), stats.trimmed_mean(li, ["l_returnflag"], "l_extendedprice", 0.1)):
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_ks_by_parts(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.random(3000) ** 1.3, None: np.r_[rng.integers(0, 7, 500) / 5 - 0.1, 2.0, -3.0], "c": np.array([0.25])}
    df = spark.createDataFrame([(k, float(v)) for k, xs in groups.items() for v in xs] + [("a", None)], "k string, v double")
    found = stats.ks_uniform(df, ["k"], "v", 0.0, 1.0)
    got = {r["k"]: (r["d"], r["n"]) for r in found.collect()}
    for k, xs in groups.items():
        p, i, n = np.clip(np.sort(xs), 0, 1), np.arange(1, len(xs) + 1), len(xs)
        assert np.isclose(got[k][0], max((i / n - p).max(), (p - (i - 1) / n).max())) and got[k][1] == n
    # values are put in order by parts of the interval, not by groups
    assert "hashpartitioning(_k#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and plan.count("_b#") > 2
