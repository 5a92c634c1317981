"""Dataset preparation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import datasets
from heliograin.plans.base import events, query, rounded, table

CHANCE = "('0x' || substr(md5('{seed}:' || {c}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"WITH u AS (SELECT doc_id, {CHANCE.format(seed=7, c='doc_id')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.2 THEN 'valid' ELSE 'test' END AS split FROM u")
def datasets_random_split(spark, d):
    return datasets.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.7, "valid": 0.2, "test": 0.1}, 7)


@query(f"WITH u AS (SELECT doc_id, source, {CHANCE.format(seed=3, c='source')} AS u FROM documents) SELECT doc_id, source, CASE WHEN u < 0.8 THEN 'train' ELSE 'test' END AS split FROM u")
def datasets_grouped_split(spark, d):
    return datasets.grouped_split(table(spark, d, "documents").select("doc_id", "source"), "source", {"train": 0.8, "test": 0.2}, 3)


@query("SELECT event_id, CASE WHEN epoch_us(ts) / 1e6 <= (SELECT quantile_cont(epoch_us(ts) / 1e6, 0.8) FROM events) THEN 'train' ELSE 'test' END AS split FROM events")
def datasets_temporal_split(spark, d):
    return datasets.temporal_split(events(spark, d).select("event_id", "t"), "t", 0.8).select("event_id", "split")


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'test' ELSE 'train' END AS split FROM documents")
def datasets_leave_one_group_out(spark, d):
    return datasets.leave_one_group_out(table(spark, d, "documents").select("doc_id", "source"), "source", "src3").select("doc_id", "split")


@query("SELECT count(*) AS rows, count(*) FILTER (l_quantity IS NULL OR isnan(l_quantity) OR l_tax IS NULL OR isnan(l_tax)) AS bad_rows FROM lineitem")
def datasets_validate(spark, d):
    return datasets.validate(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])


@query(
    "WITH h AS (SELECT ('0x' || substr(sha256(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT, CASE WHEN o_custkey % 5 = 0 THEN chr(0) ELSE o_orderpriority END)), 1, 15))::BIGINT AS h FROM orders) "
    "SELECT count(*) AS rows, sum(h)::VARCHAR AS sum, bit_xor(h) AS xor FROM h"
)
def datasets_content_digest(spark, d):
    o = table(spark, d, "orders")
    return datasets.content_digest(o, ["o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority"))])


HOLES = "h AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 3 > 0 THEN NULL ELSE l_tax END AS x, 1.0::DOUBLE AS c FROM lineitem)"


@query(f"WITH {HOLES}, m AS (SELECT median(q) AS m FROM h WHERE l_orderkey % 2 = 0) SELECT l_partkey, round(sum(coalesce(q, m)), 4) AS q, count(*) AS n FROM h, m GROUP BY ALL")
def datasets_impute(spark, d):
    li = table(spark, d, "lineitem")
    h = li.select("l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).cast("double").alias("q"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_tax")).alias("x"), F.lit(1.0).alias("c"))
    medians = datasets.fit_imputer(h.filter("l_orderkey % 2 = 0"), ["q", "x", "c"])
    done = datasets.impute(h, medians).select("l_partkey", *sorted(medians))
    return rounded(done.groupBy("l_partkey").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n")))


@query(
    "SELECT l_returnflag, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) AS rmse, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(median(abs(l_extendedprice - l_quantity * 1500)), 4) AS median_error, round(max(abs(l_extendedprice - l_quantity * 1500)), 4) AS worst_error FROM lineitem GROUP BY ALL"
)
def datasets_regression_errors(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return rounded(datasets.regression_errors(li, ["l_returnflag"], "l_extendedprice", "p"))


SCORED = "s AS (SELECT quality, toxic, lang, n_chars % 1000 / 1000 AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 1000 / 1000).alias("score")), "doc_id")


@query(
    f"WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (score > 0.5 AND quality = 1) AS tp, count(*) FILTER (score > 0.5 AND quality <> 1) AS fp, count(*) FILTER (score <= 0.5 AND quality = 1) AS fn, count(*) FILTER (score <= 0.5 AND quality <> 1) AS tn FROM s GROUP BY ALL), "
    "r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tn / nullif(tn + fp, 0) AS t FROM c) SELECT lang, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1, "
    "round(fp / nullif(fp + tn, 0), 6) AS false_alarm_rate, round(fn / nullif(tp + fn, 0), 6) AS missed_rate, round((r + t) / 2, 6) AS balanced_accuracy FROM r"
)
def datasets_detection_report(spark, d):
    return rounded(datasets.detection_report(_scored(spark, d), ["lang"], "quality", "score", 0.5), 6)


@query(
    f"WITH {SCORED}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM s), a AS (SELECT lang, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n, sum(r) FILTER (quality = 1) AS rs FROM r GROUP BY ALL) "
    "SELECT lang, round((rs - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM a"
)
def datasets_auroc(spark, d):
    return rounded(datasets.auroc(_scored(spark, d), ["lang"], "quality", "score"), 6)


@query(
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS a, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS b, "
    "(SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT round((t + 2 * ab - a - b) / t, 6) AS rand, round((ab - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS adjusted_rand FROM s"
)
def datasets_rand_indexes(spark, d):
    return rounded(datasets.rand_indexes(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 6)


RESIDUAL = "r AS (SELECT o_orderpriority AS g, o_totalprice - 150000 AS e FROM orders)"


def _residuals(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") - 150000).alias("e"))


@query(f"WITH {RESIDUAL}, k AS (SELECT g, abs(e) AS a, row_number() OVER (PARTITION BY g ORDER BY abs(e)) AS i, count(*) OVER (PARTITION BY g) AS n FROM r) SELECT g, max(n) AS n, round(max(a) FILTER (i = ceil((n + 1) * 0.9)), 4) AS half_width FROM k GROUP BY ALL")
def datasets_conformal_width(spark, d):
    return rounded(datasets.conformal_width(_residuals(spark, d), ["g"], "e", 0.9))


@query(
    "WITH r AS (SELECT s_nationkey AS g, abs(s_acctbal) AS a FROM supplier), k AS (SELECT g, a, row_number() OVER (PARTITION BY g ORDER BY a) AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (ORDER BY a) AS pi, count(*) OVER () AS pn FROM r), p AS (SELECT max(a) FILTER (pi = ceil((pn + 1) * 0.8)) AS pooled FROM k), "
    "w AS (SELECT g, max(n) AS n, max(a) FILTER (i = ceil((n + 1) * 0.8)) AS own FROM k GROUP BY ALL) SELECT g, n, round(coalesce(own, pooled), 4) AS half_width, own IS NOT NULL AS conditionally_valid FROM w, p"
)
def datasets_mondrian_width(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("e"))
    return rounded(datasets.mondrian_width(s, "g", "e", 0.8))


@query("SELECT o_orderpriority AS g, round(avg((abs(o_totalprice - 150000) <= 90000)::INT), 6) AS coverage FROM orders GROUP BY ALL")
def datasets_coverage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice", F.lit(150000.0).alias("p"), F.lit(90000.0).alias("w"))
    return rounded(datasets.coverage(o, ["g"], "o_totalprice", "p", "w"), 6)


@query(
    "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey % 2 AS side, least(greatest(floor((l_extendedprice - lo) / (hi - lo) * 10), 0), 9) AS bin FROM lineitem, e), "
    "c AS (SELECT g.bin, count(b.bin) FILTER (side = 0) AS r, count(b.bin) FILTER (side = 1) AS c FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.bin = g.bin GROUP BY ALL), t AS (SELECT sum(r) AS tr, sum(c) AS tc FROM c) "
    "SELECT round(sum(((c + 0.5) / tc - (r + 0.5) / tr) * ln(((c + 0.5) / tc) / ((r + 0.5) / tr))), 8) AS psi FROM c, t"
)
def datasets_stability_index(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(datasets.stability_index(li.filter("l_orderkey % 2 = 0"), li.filter("l_orderkey % 2 = 1"), "l_extendedprice", 10), 8)


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice - l_quantity * 1500), 4) AS mean, round(avg(l_extendedprice - l_quantity * 1500) / stddev_samp(l_extendedprice - l_quantity * 1500), 6) AS effect_size FROM lineitem GROUP BY ALL")
def datasets_paired_differences(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    r = datasets.paired_differences(li, ["l_returnflag"], "l_extendedprice", "p")
    return r.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("effect_size", 6).alias("effect_size"))


def _poisson(u: str) -> str:
    """SQL of the Poisson(1) weight of a uniform number: how many of the cumulative probabilities it reaches."""
    upto, term, parts = 0.0, 0.36787944117144233, []
    for k in range(8):
        upto += term
        parts.append(f"({u} >= {upto!r}::DOUBLE)::INT")
        term /= k + 1
    return " + ".join(parts)


@query(
    f"WITH u AS (SELECT p_retailprice - p_size * 30.0 AS d, k, {CHANCE.format(seed=0, c="p_partkey || ':' || k")} AS u FROM part, (SELECT unnest(range(1, 101)) AS k)), w AS (SELECT k, d, {_poisson('u')} AS w FROM u), m AS (SELECT k, sum(w * d) / sum(w) AS m FROM w GROUP BY k) "
    "SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m"
)
def datasets_paired_bootstrap(spark, d):
    s = table(spark, d, "part").withColumn("other", F.col("p_size") * 30.0)
    return rounded(datasets.paired_bootstrap(s, "p_retailprice", "other", "p_partkey", 100, 0.025, 0.975))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders QUALIFY (batch + 1) * 64 <= count(*) OVER ()")
def datasets_batches(spark, d):
    return datasets.batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 64, drop_last=True)


@query("SELECT vec_id, round(list_sum(embedding[1:40]::DOUBLE[]), 4) AS total, 80 AS length FROM embeddings")
def datasets_padding(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", datasets.pad(F.slice(F.col("embedding").cast("array<double>"), 1, 40), 80))
    return rounded(e.select("vec_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("v").alias("length")))


@query(f"WITH u AS (SELECT o_orderkey, o_totalprice, {CHANCE.format(seed=11, c='o_orderkey')} < 0.05 AS spiked FROM orders) SELECT o_orderkey, spiked, round(o_totalprice + CASE WHEN spiked THEN 1000000 ELSE 0 END, 2) AS o_totalprice FROM u")
def datasets_contaminate(spark, d):
    c = datasets.contaminate(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 0.05, 1000000.0, 11)
    return rounded(c, 2)


@query(
    "WITH e AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part), b AS (SELECT least(floor((p_size - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, sum(p_retailprice) AS s, count(*) AS n FROM part, e GROUP BY ALL), p AS (SELECT i.bin AS i, j.bin AS j, (SELECT sum(s) / sum(n) FROM b WHERE bin BETWEEN i.bin AND j.bin) AS m FROM b i JOIN b j ON i.bin <= j.bin), "
    "l AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM p) SELECT j AS bin, round(max(low), 4) AS fit FROM l GROUP BY ALL"
)
def datasets_isotonic(spark, d):
    return rounded(datasets.isotonic_blocks(table(spark, d, "part"), "p_size", "p_retailprice", 10))
