"""Signal, control-chart and navigation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import signal
from heliograin.plans.base import CANDLES, EVENTS, candles, events, query, rounded, table

K, O = ["user_id"], ["t", "event_id"]


@query(
    "SELECT user_id, round(sqrt(avg(value * value)), 4) AS rms, round(max(abs(value)), 4) AS peak, round(max(value) - min(value), 4) AS peak_to_peak, round(max(abs(value)) / sqrt(avg(value * value)), 4) AS crest_factor, round(sum(value * value), 2) AS energy, round(avg(value), 4) AS mean, "
    "round(avg((value - m) ** 3) / sd ** 3, 4) + 0.0 AS skewness, round(avg((value - m) ** 4) / sd ** 4 - 3, 4) + 0.0 AS kurtosis FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS sd FROM events) GROUP BY user_id, sd"
)
def signal_time_features(spark, d):
    r = signal.time_features(events(spark, d), K, "value")
    return rounded(r.withColumn("energy", F.round("energy", 2)))


@query(f"WITH {EVENTS}, s AS (SELECT user_id, CASE WHEN value - 50 >= 0 THEN 1 ELSE -1 END AS s, t, event_id FROM events_t), c AS (SELECT user_id, CASE WHEN lag(s) OVER (PARTITION BY user_id ORDER BY t, event_id) <> s THEN 1 ELSE 0 END AS c FROM s) SELECT user_id, round(CASE WHEN count(*) > 1 THEN sum(c) / (count(*) - 1) ELSE 0 END, 6) AS zero_crossing_rate FROM c GROUP BY ALL")
def signal_zero_crossings(spark, d):
    return rounded(signal.zero_crossing_rate(events(spark, d).withColumn("x", F.col("value") - 50), K, O, "x"), 6)


@query(f"WITH {EVENTS}, p AS (SELECT user_id, value * lag(value, 2) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM events_t) SELECT user_id, round(avg(p), 2) AS autocorrelation FROM p GROUP BY ALL")
def signal_autocorrelation(spark, d):
    return rounded(signal.autocorrelation(events(spark, d), K, O, "value", 2), 2)


@query("WITH e AS (SELECT user_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events), b AS (SELECT user_id, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 64), 63) ELSE 0 END AS b, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM b GROUP BY ALL")
def signal_entropy(spark, d):
    return rounded(signal.histogram_entropy(events(spark, d), K, "value"), 6)


SPECTRUM = f"{CANDLES}, s AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles), f AS (SELECT symbol, bin, (sum(close * cos(2 * pi() * ((bin * i) % n) / n)) ** 2 + sum(close * sin(2 * pi() * ((bin * i) % n) / n)) ** 2) / any_value(n) AS power FROM s, (SELECT unnest(range(8))::INT AS bin) GROUP BY ALL)"


@query(f"WITH {SPECTRUM} SELECT symbol, bin, round(power / 1e6, 2) AS power FROM f")
def signal_spectrum(spark, d):
    return rounded(signal.spectrum(candles(spark, d), ["symbol"], ["day"], "close", 8).withColumn("power", F.col("power") / 1e6), 2)


@query(f"WITH {SPECTRUM}, g AS (SELECT * FROM f WHERE bin > 0) SELECT symbol, round(sum(bin * power) / sum(power), 4) AS centroid, round(sqrt(sum(bin * bin * power) / sum(power) - (sum(bin * power) / sum(power)) ** 2), 4) AS spread, round(log2(sum(power)) - sum(power * log2(power)) / sum(power), 4) AS entropy, round(exp(avg(ln(power))) / avg(power), 4) AS flatness FROM g GROUP BY ALL")
def signal_spectral_summary(spark, d):
    p = signal.spectrum(candles(spark, d), ["symbol"], ["day"], "close", 8).filter("bin > 0")
    return rounded(signal.spectral_summary(p, ["symbol"]))


@query("SELECT i, round(0.5 - 0.5 * cos(2 * pi() * i / 63), 6) + 0.0 AS hanning, round(0.54 - 0.46 * cos(2 * pi() * i / 63), 6) AS hamming, round(0.42 - 0.5 * cos(2 * pi() * i / 63) + 0.08 * cos(4 * pi() * i / 63), 6) + 0.0 AS blackman FROM (SELECT unnest(range(64)) AS i)")
def signal_tapers(spark, d):
    r = spark.range(64).withColumnRenamed("id", "i")
    return rounded(r.select("i", *[signal.taper(k, F.col("i"), F.lit(64)).alias(k) for k in ("hanning", "hamming", "blackman")]), 6)


def _cfar(kind, noise):
    return (
        f"WITH {CANDLES}, c AS (SELECT symbol, day, high AS x, list(high) OVER l AS a, list(high) OVER r AS b FROM candles WINDOW l AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING), r AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)) "
        f"SELECT symbol, day, coalesce(len(a) = 5 AND len(b) = 5 AND x > 1.2 * {noise}, false) AS detected FROM c"
    )


def _detect(spark, d, kind):
    return signal.cfar(candles(spark, d), ["symbol"], ["day"], "high", 1, 5, 1.2, kind).select("symbol", "day", "detected")


@query(_cfar("ca", "(list_avg(a) + list_avg(b)) / 2"))
def signal_cfar_ca(spark, d):
    return _detect(spark, d, "ca")


@query(_cfar("go", "greatest(list_avg(a), list_avg(b))"))
def signal_cfar_go(spark, d):
    return _detect(spark, d, "go")


@query(_cfar("so", "least(list_avg(a), list_avg(b))"))
def signal_cfar_so(spark, d):
    return _detect(spark, d, "so")


@query(_cfar("tm", "list_sum(list_sort(list_concat(a, b))[3:8]) / 6"))
def signal_cfar_tm(spark, d):
    return _detect(spark, d, "tm")


@query(
    "WITH g AS (SELECT l_suppkey % 30 AS x, l_partkey % 30 AS y, round(sum(l_quantity) * 100)::BIGINT AS p FROM lineitem GROUP BY ALL), b AS (SELECT a.x, a.y, a.p, count(*) AS n, sum(b.p) AS s, sum(b.p) FILTER (abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) AS c FROM g a JOIN g b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY ALL) "
    "SELECT x, y, p, n = 49 AND p > 1.1 * (s - c) / 40 AS detected FROM b"
)
def signal_cfar_2d(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 30).alias("x"), (F.col("l_partkey") % 30).alias("y")).agg(F.round(F.sum("l_quantity") * 100).cast("long").alias("p"))
    return signal.cfar_2d(g, [], "x", "y", "p", 1, 2, 1.1)


@query(_cfar("os", "list_sort(list_concat(a, b))[7]"))
def signal_cfar_os(spark, d):
    return _detect(spark, d, "os")


@query(
    _cfar("ca", "(list_avg(a) + list_avg(b)) / 2").replace("SELECT symbol, day, coalesce", ", q AS (SELECT symbol, day, x, coalesce", 1)
    + "), g AS (SELECT *, CASE WHEN lag(detected) OVER w IS NOT DISTINCT FROM detected THEN 0 ELSE 1 END AS ch FROM q WINDOW w AS (PARTITION BY symbol ORDER BY day)), k AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM g) "
    "SELECT symbol, run::BIGINT AS run, min(day) AS start, count(*) AS length, max(x) AS peak FROM k WHERE detected GROUP BY symbol, run"
)
def signal_clusters(spark, d):
    return signal.clusters(signal.cfar(candles(spark, d), ["symbol"], ["day"], "high", 1, 5, 1.2), ["symbol"], ["day"], "high")


@query(f"WITH {CANDLES}, p AS (SELECT symbol, day, close, lag(close) OVER w AS a, lead(close) OVER w AS b FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT symbol, day, close FROM p WHERE close > 200000 AND close > a AND close >= b")
def signal_peaks(spark, d):
    return signal.peaks(candles(spark, d), ["symbol"], ["day"], "close", 200000.0).select("symbol", "day", "close")


@query(
    f"WITH {EVENTS}, r AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS rr FROM events_t), q AS (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id ORDER BY t) AS df FROM r) "
    "SELECT user_id, round(coalesce(1000 * stddev_samp(rr), 0), 0) AS sdnn, round(coalesce(1000 * sqrt(avg(df * df)), 0), 0) AS rmssd, round(coalesce(100 * avg((abs(df) > 0.05)::INT), 0), 4) AS pnn50, round(coalesce(60 / avg(rr), 0), 6) AS mean_rate FROM q GROUP BY ALL"
)
def signal_heart_rate_variability(spark, d):
    r = signal.heart_rate_variability(events(spark, d), K, "t")
    return r.select("user_id", F.round("sdnn", 0).alias("sdnn"), F.round("rmssd", 0).alias("rmssd"), F.round("pnn50", 4).alias("pnn50"), F.round("mean_rate", 6).alias("mean_rate"))


SHIPS = "ships AS (SELECT s_nationkey % 5 AS t, s_suppkey AS id, (s_suppkey * 37 % 100)::DOUBLE AS x, (s_suppkey * 53 % 100)::DOUBLE AS y, (s_suppkey % 7 - 3)::DOUBLE AS vx, (s_suppkey % 5 - 2)::DOUBLE AS vy FROM supplier)"


@query(
    f"WITH {SHIPS}, p AS (SELECT a.t, a.id AS a, b.id AS b, b.x - a.x AS dx, b.y - a.y AS dy, b.vx - a.vx AS ux, b.vy - a.vy AS uy FROM ships a JOIN ships b ON a.t = b.t AND a.id < b.id AND abs(floor(a.x / 20) - floor(b.x / 20)) <= 1 AND abs(floor(a.y / 20) - floor(b.y / 20)) <= 1), "
    "q AS (SELECT *, CASE WHEN ux * ux + uy * uy < 1e-12 THEN 0 ELSE -(dx * ux + dy * uy) / (ux * ux + uy * uy) END AS tcpa FROM p) SELECT t, a, b, round(tcpa, 4) + 0.0 AS tcpa, round(sqrt((dx + ux * tcpa) ** 2 + (dy + uy * tcpa) ** 2), 4) + 0.0 AS cpa FROM q"
)
def signal_closest_approach(spark, d):
    s = table(spark, d, "supplier")
    n = F.col("s_suppkey")
    ships = s.select((F.col("s_nationkey") % 5).alias("t"), n.alias("id"), (n * 37 % 100).cast("double").alias("x"), (n * 53 % 100).cast("double").alias("y"), (n % 7 - 3).cast("double").alias("vx"), (n % 5 - 2).cast("double").alias("vy"))
    return rounded(signal.closest_approach(ships, "t", "id", "x", "y", "vx", "vy", 20.0))


@query("SELECT s_suppkey, CASE WHEN abs(b) <= 15 THEN 'head_on' WHEN abs(b) >= 112.5 THEN 'overtaking' WHEN b > 0 THEN 'give_way' ELSE 'stand_on' END AS encounter FROM (SELECT s_suppkey, (s_suppkey * 29 + 180) % 360 - 180 AS b FROM supplier)")
def signal_encounters(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", signal.encounter((F.col("s_suppkey") * 29).cast("double")).alias("encounter"))


@query(
    f"WITH {CANDLES}, z AS (SELECT symbol, day, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_samp(close) OVER (PARTITION BY symbol) AS z FROM candles), r AS (SELECT symbol, day, z, "
    "CASE WHEN abs(z) > 3 THEN 1 WHEN count(*) FILTER (z > 2) OVER w3 >= 2 OR count(*) FILTER (z < -2) OVER w3 >= 2 THEN 2 WHEN count(*) FILTER (z > 1) OVER w5 >= 4 OR count(*) FILTER (z < -1) OVER w5 >= 4 THEN 3 WHEN count(*) FILTER (z > 0) OVER w8 >= 8 OR count(*) FILTER (z < 0) OVER w8 >= 8 THEN 4 ELSE 0 END AS rule "
    "FROM z WINDOW w3 AS (PARTITION BY symbol ORDER BY day ROWS 2 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING), w8 AS (PARTITION BY symbol ORDER BY day ROWS 7 PRECEDING)) SELECT symbol, day, round(z, 4) + 0.0 AS z, rule FROM r"
)
def signal_shewhart(spark, d):
    return rounded(signal.shewhart(candles(spark, d), ["symbol"], ["day"], "close").select("symbol", "day", "z", "rule"))


@query(
    f"WITH {CANDLES}, p AS (SELECT symbol, day, sum((close - 150000) / 80000 - 0.5) OVER w AS up, sum(-(close - 150000) / 80000 - 0.5) OVER w AS dn FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT symbol, day, up - least(min(up) OVER w, 0) AS hi, dn - least(min(dn) OVER w, 0) AS lo FROM p WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)) SELECT symbol, day, round(hi, 9) AS cusum_high, round(lo, 9) AS cusum_low, CASE WHEN hi > 4 THEN 'high' WHEN lo > 4 THEN 'low' END AS signal FROM c"
)
def signal_cusum(spark, d):
    return rounded(signal.cusum(candles(spark, d), ["symbol"], ["day"], "close", 150000.0, 80000.0, 0.5, 4.0).select("symbol", "day", "cusum_high", "cusum_low", "signal"), 9)


@query("SELECT user_id, round(covar_pop(epoch_us(ts) / 1e6 - 1704067200, value) / var_pop(epoch_us(ts) / 1e6 - 1704067200) * 1e6, 4) AS rocof FROM events GROUP BY ALL")
def signal_rocof(spark, d):
    r = signal.rocof(events(spark, d).withColumn("t", F.col("t") - 1704067200), K, "t", "value")
    return rounded(r.withColumn("rocof", F.col("rocof") * 1e6))
