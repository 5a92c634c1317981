"""Time-series window queries over daily candles of order prices and over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import market, windows
from heliograin.plans.base import CANDLES, EVENTS, candles, events, query, rounded, table

K, O = ["symbol"], ["day"]
S = windows.Series(K, O)
W = "WINDOW w AS (PARTITION BY symbol ORDER BY day), w5 AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING)"


def _full(expression: str) -> str:
    return f"CASE WHEN count(*) OVER w5 = 5 THEN round({expression}, 4) + 0.0 END"


def _sql(columns: str) -> str:
    return f"WITH {CANDLES}, x AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS before FROM candles) SELECT symbol, day, {columns} FROM x {W}"


def _tp(spark, d):
    return candles(spark, d).withColumn("tp", windows.typical_price("high", "low", "close"))


def _out(df, **columns):
    return rounded(df.select("symbol", "day", *[c.alias(n) for n, c in columns.items()]))


@query(f"WITH {CANDLES} SELECT symbol, day, open, high, low, close, volume FROM candles")
def series_candles(spark, d):
    return candles(spark, d).select("symbol", "day", "open", "high", "low", "close", "volume")


@query(_sql("round(close - lag(close) OVER w, 4) AS difference, round(close - lag(close, 3) OVER w, 4) AS momentum, round(100 * (close - lag(close, 3) OVER w) / lag(close, 3) OVER w, 4) AS roc, round(tp, 4) AS typical"))
def series_differences(spark, d):
    return _out(_tp(spark, d), difference=S.difference("close"), momentum=S.momentum("close", 3), roc=S.roc("close", 3), typical=F.col("tp"))


@query(_sql(f"{_full('avg(close) OVER w5')} AS sma, {_full('max(high) OVER w5')} AS rolling_max, {_full('min(low) OVER w5')} AS rolling_min, {_full('(close - avg(close) OVER w5) / stddev_samp(close) OVER w5')} AS zscore"))
def series_rolling(spark, d):
    return _out(candles(spark, d), sma=S.sma("close", 5), rolling_max=S.rolling_max("high", 5), rolling_min=S.rolling_min("low", 5), zscore=S.zscore("close", 5))


@query(_sql(f"{_full('avg(close) OVER w5 - 2 * stddev_pop(close) OVER w5')} AS lower, {_full('avg(close) OVER w5')} AS middle, {_full('avg(close) OVER w5 + 2 * stddev_pop(close) OVER w5')} AS upper"))
def series_bollinger(spark, d):
    lower, middle, upper = S.bollinger("close", 5, 2.0)
    return _out(candles(spark, d), lower=lower, middle=middle, upper=upper)


@query(_sql("round(greatest(high - low, abs(high - before), abs(low - before)), 4) AS true_range"))
def series_true_range(spark, d):
    return _out(candles(spark, d), true_range=S.true_range("high", "low", "close"))


@query(_sql(f"{_full('100 * (close - min(low) OVER w5) / (max(high) OVER w5 - min(low) OVER w5)')} AS stochastic, {_full('-100 * (max(high) OVER w5 - close) / (max(high) OVER w5 - min(low) OVER w5)')} AS williams"))
def series_stochastic(spark, d):
    return _out(candles(spark, d), stochastic=S.stochastic("high", "low", "close", 5), williams=S.williams_r("high", "low", "close", 5))


@query(_sql(f"{_full('(tp - avg(tp) OVER w5) / (0.015 * list_sum(list_transform(list(tp) OVER w5, lambda v: abs(v - avg(tp) OVER w5))) / 5)')} AS cci").replace("lambda v: abs(v - avg(tp) OVER w5)", "lambda v: abs(v - m)").replace("(tp - avg(tp) OVER w5)", "(tp - m)").replace("AS before FROM candles)", "AS before FROM candles), y AS (SELECT *, avg(tp) OVER (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING) AS m FROM x)").replace("FROM x WINDOW", "FROM y WINDOW"))
def series_cci(spark, d):
    return _out(_tp(spark, d), cci=S.cci("tp", 5))


@query(_sql("round(sum(coalesce(sign(close - before) * volume, 0)) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS obv"))
def series_obv(spark, d):
    return _out(windows.on_balance_volume(candles(spark, d), K, O, "close", "volume"), obv=F.col("obv"))


@query(
    f"WITH {CANDLES}, x AS (SELECT *, (high + low + close) / 3 AS tp FROM candles), y AS (SELECT *, tp - lag(tp) OVER (PARTITION BY symbol ORDER BY day) AS dir FROM x), "
    f"z AS (SELECT symbol, day, count(dir) OVER w5 AS n, sum(CASE WHEN dir > 0 THEN tp * volume ELSE 0 END) OVER w5 AS up, sum(CASE WHEN dir < 0 THEN tp * volume ELSE 0 END) OVER w5 AS down FROM y {W}) "
    "SELECT symbol, day, CASE WHEN n = 5 THEN CASE WHEN down < 1e-12 THEN 100.0 ELSE round(100 - 100 / (1 + up / down), 4) END END AS mfi FROM z"
)
def series_mfi(spark, d):
    return _out(windows.money_flow_index(_tp(spark, d), K, O, "tp", "volume", 5), mfi=F.col("mfi"))


@query(_sql(f"{_full('CASE WHEN sum(volume) OVER w5 > 1e-12 THEN sum(tp * volume) OVER w5 / sum(volume) OVER w5 ELSE 0 END')} AS vwap, {_full('CASE WHEN sum(volume) OVER w5 > 1e-12 THEN sum(CASE WHEN high - low > 1e-12 THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER w5 / sum(volume) OVER w5 ELSE 0 END')} AS cmf"))
def series_volume_price(spark, d):
    return _out(_tp(spark, d), vwap=S.vwap("tp", "volume", 5), cmf=S.chaikin_money_flow("high", "low", "close", "volume", 5))


@query(_sql(f"{_full('max(high) OVER w5')} AS upper, {_full('min(low) OVER w5')} AS lower, {_full('(max(high) OVER w5 + min(low) OVER w5) / 2')} AS middle"))
def series_donchian(spark, d):
    upper, lower, middle = S.donchian("high", "low", 5)
    return _out(candles(spark, d), upper=upper, lower=lower, middle=middle)


@query(_sql(f"{_full('sqrt(avg(close * close) OVER w5)')} AS rms"))
def series_cycle_rms(spark, d):
    return _out(candles(spark, d), rms=S.cycle_rms("close", 5))


def _mirrored(fold: str) -> str:
    # position p of the 5-row window around row i, mirrored at the ends
    return f"""WITH {CANDLES}, s AS (SELECT symbol, list(close ORDER BY day) AS v, list(day ORDER BY day) AS days FROM candles GROUP BY ALL),
    i AS (SELECT symbol, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i, unnest(days) AS day, FROM s),
    w AS (SELECT symbol, day, v[i] AS x, list_transform(range(-2, 3), lambda k: v[CASE WHEN i + k < 1 THEN 2 - i - k WHEN i + k > n THEN 2 * n - i - k ELSE i + k END]) AS w FROM i)
    SELECT symbol, day, {fold} FROM w"""


@query(_mirrored("round(list_avg(w), 4) AS smooth"))
def series_centred_mean(spark, d):
    return _out(windows.centred(candles(spark, d), K, O, "close", 2, windows.mean_of), smooth=F.col("smooth"))


@query(_mirrored("round(list_median(w), 4) AS smooth"))
def series_median_filter(spark, d):
    return _out(windows.centred(candles(spark, d), K, O, "close", 2, windows.median_of), smooth=F.col("smooth"))


def _kernel(weights):
    total = sum(weights)
    return _mirrored("round(" + " + ".join(f"w[{k + 1}] * {x / total!r}::DOUBLE" for k, x in enumerate(weights)) + ", 4) AS smooth")


@query(_kernel(windows.gaussian_weights(1.0, 2)))
def series_gaussian(spark, d):
    return _out(windows.centred(candles(spark, d), K, O, "close", 2, windows.kernel_of(windows.gaussian_weights(1.0, 2))), smooth=F.col("smooth"))


@query(_kernel([-3.0, 12.0, 17.0, 12.0, -3.0]))
def series_savitzky_golay(spark, d):
    return _out(windows.centred(candles(spark, d), K, O, "close", 2, windows.kernel_of(windows.polynomial_weights(2, 2))), smooth=F.col("smooth"))


@query(_mirrored("round(list_avg(list_sort(w)[2:4]), 4) AS smooth"))
def series_alpha_trimmed(spark, d):
    return _out(windows.centred(candles(spark, d), K, O, "close", 2, windows.alpha_trimmed(0.2)), smooth=F.col("smooth"))


@query(
    _mirrored("x, list_median(w) AS m, list_median(list_transform(w, lambda q: abs(q - list_median(w)))) AS s").replace("WITH", "SELECT symbol, day, round(m, 4) AS smooth, (s > 0 AND abs(x - m) > 2 * 1.4826 * s) AS impulse, round(CASE WHEN s > 0 AND abs(x - m) > 2 * 1.4826 * s THEN m ELSE x END, 4) AS repaired FROM (WITH", 1)
    + ")"
)
def series_hampel(spark, d):
    r = windows.hampel(candles(spark, d), K, O, "close", 2, 2.0)
    return _out(r, smooth=F.col("smooth"), impulse=F.col("impulse"), repaired=F.col("repaired"))


@query(f"WITH {CANDLES}, x AS (SELECT symbol, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS d FROM candles) SELECT symbol, round(coalesce(sum(d), 0), 2) AS total_variation FROM x GROUP BY ALL")
def series_total_variation(spark, d):
    return rounded(windows.total_variation(candles(spark, d), K, O, "close"), 2)


@query(
    f"WITH {CANDLES}, a AS (SELECT symbol, day, close, lead(close) OVER (PARTITION BY symbol ORDER BY day) AS nxt FROM candles), b AS (SELECT symbol, day, close FROM a WHERE nxt IS NULL OR nxt <> close), "
    "c AS (SELECT *, close - lag(close) OVER w AS p, lead(close) OVER w - close AS q FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT symbol, day, close FROM c WHERE p IS NULL OR q IS NULL OR p * q < 0"
)
def series_reversals(spark, d):
    return windows.reversals(candles(spark, d).select("symbol", "day", "close"), K, O, "close")


RATIO = "close / avg(close) OVER (PARTITION BY symbol)"


@query(
    f"WITH {CANDLES}, r AS (SELECT symbol, day, {RATIO} AS r FROM candles), c AS (SELECT *, CASE WHEN r < 0.1 THEN 'interruption' WHEN r < 0.9 THEN 'sag' WHEN r > 1.1 THEN 'swell' ELSE 'normal' END AS class FROM r), "
    "g AS (SELECT *, CASE WHEN lag(class) OVER w IS NOT DISTINCT FROM class THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)), s AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM g) "
    "SELECT symbol, run::BIGINT AS run, any_value(class) AS class, count(*) AS length, round(CASE WHEN any_value(class) = 'swell' THEN max(r) ELSE min(r) END, 4) AS extreme FROM s WHERE class <> 'normal' GROUP BY symbol, run"
)
def series_voltage_events(spark, d):
    from pyspark.sql import Window

    c = candles(spark, d).withColumn("r", F.col("close") / F.avg("close").over(Window.partitionBy("symbol")))
    return rounded(windows.voltage_events(c, K, O, "r"))


@query(
    "WITH e AS (SELECT event_id, user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), a(name, power) AS (VALUES ('kettle', 40.0), ('heater', 55.0), ('lamp', 5.0), ('pump', 20.0)), "
    "m AS (SELECT event_id, name, abs(abs(step) - power) AS off FROM e, a WHERE abs(step) > 1e-12 AND abs(abs(step) - power) <= 0.1 * power) SELECT event_id, arg_min(name, (off, name)) AS name, round(min(off), 4) AS off FROM m GROUP BY ALL"
)
def series_nearest_step(spark, d):
    steps = events(spark, d).withColumn("step", windows.Series(["user_id"], ["ts", "event_id"]).difference("value")).select("event_id", "step").filter("step is not null")
    appliances = spark.createDataFrame([("kettle", 40.0), ("heater", 55.0), ("lamp", 5.0), ("pump", 20.0)], "name string, power double")
    return rounded(windows.nearest_step(steps, appliances, "step", "power", "name", 0.1).select("event_id", "name", "off"))


@query(
    f"WITH {CANDLES}, f AS (SELECT symbol, close AS a, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS p FROM candles) SELECT symbol, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) ** 2)), 4) AS rmse, round(100 * avg(abs((a - p) / a)), 4) AS mape FROM f WHERE p IS NOT NULL GROUP BY ALL"
)
def series_forecast_errors(spark, d):
    c = candles(spark, d).withColumn("p", S.lag("close")).filter("p is not null")
    return rounded(windows.forecast_errors(c, K, "close", "p"))


@query(
    f"WITH {EVENTS}, n AS (SELECT user_id, t, max(value) AS v FROM events_t WHERE event_type = 'purchase' GROUP BY ALL), q AS (SELECT event_id, user_id, t FROM events_t WHERE event_type = 'click'), "
    "l AS (SELECT q.*, n.t AS lt, n.v AS lv FROM q ASOF LEFT JOIN n ON q.user_id = n.user_id AND q.t >= n.t), b AS (SELECT l.*, n.t AS rt, n.v AS rv FROM l ASOF LEFT JOIN n ON l.user_id = n.user_id AND l.t <= n.t) "
    "SELECT event_id, round(CASE WHEN rt IS NULL THEN lv WHEN lt IS NULL THEN rv WHEN t - lt <= rt - t THEN lv ELSE rv END, 4) AS value FROM b"
)
def series_nearest_interpolation(spark, d):
    e = events(spark, d)
    nodes = e.filter("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("v"))
    points = e.filter("event_type = 'click'").select("event_id", "user_id", "t")
    return rounded(windows.interpolate(points, nodes, ["user_id"], "t", "v", "nearest").select("event_id", "value"))


@query(
    f"WITH {EVENTS}, m AS (SELECT user_id, t, max(value) AS v FROM events_t WHERE event_type = 'purchase' GROUP BY ALL), n AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t)), "
    "q AS (SELECT event_id, user_id, t FROM events_t WHERE event_type = 'click'), l AS (SELECT q.*, n.t AS lt, n.v AS lv, n.pt, n.pv FROM q ASOF LEFT JOIN n ON q.user_id = n.user_id AND q.t >= n.t), "
    "b AS (SELECT l.*, n.t AS rt, n.v AS rv, n.nt, n.nv FROM l ASOF LEFT JOIN n ON l.user_id = n.user_id AND l.t <= n.t), "
    "c AS (SELECT event_id, t, lv, rv, CASE WHEN lt IS NULL THEN rt WHEN rt IS NULL THEN pt ELSE lt END AS x0, CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL THEN pv ELSE lv END AS y0, "
    "CASE WHEN lt IS NULL THEN nt WHEN rt IS NULL THEN lt ELSE rt END AS x1, CASE WHEN lt IS NULL THEN nv WHEN rt IS NULL THEN lv ELSE rv END AS y1 FROM b) "
    "SELECT event_id, round(CASE WHEN x0 IS NULL OR x1 IS NULL OR x0 = x1 THEN coalesce(lv, rv) ELSE y0 + (y1 - y0) * (t - x0) / (x1 - x0) END, 2) AS value FROM c"
)
def series_linear_interpolation(spark, d):
    e = events(spark, d)
    nodes = e.filter("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("v"))
    points = e.filter("event_type = 'click'").select("event_id", "user_id", "t")
    return rounded(windows.interpolate(points, nodes, ["user_id"], "t", "v").select("event_id", "value"), 2)


@query(
    f"""WITH {CANDLES}, x AS (SELECT symbol, day, open o, high h, low l, close c, lag(open) OVER w o1, lag(close) OVER w c1, lag(high) OVER w h1, lag(low) OVER w l1, lag(open, 2) OVER w o2, lag(close, 2) OVER w c2 FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    p AS (SELECT symbol, day, unnest(list_filter([
      CASE WHEN h - l > 0 AND abs(c - o) <= 0.1 * (h - l) THEN 'doji' END, CASE WHEN c1 < o1 AND c > o AND o <= c1 AND c >= o1 THEN 'bullish_engulfing' END, CASE WHEN c1 > o1 AND c < o AND o >= c1 AND c <= o1 THEN 'bearish_engulfing' END,
      CASE WHEN c2 > o2 AND c1 > o1 AND c > o AND c1 > c2 AND c > c1 THEN 'three_white_soldiers' END, CASE WHEN h - l > 0 AND abs(c - o) >= 0.95 * (h - l) THEN 'marubozu' END,
      CASE WHEN c2 > o2 AND abs(c1 - o1) < 0.5 * abs(c2 - o2) AND c < o AND c < (o2 + c2) / 2 THEN 'evening_star' END], lambda q: q IS NOT NULL)) AS pattern FROM x)
    SELECT symbol, pattern, count(*) AS n FROM p GROUP BY ALL"""
)
def series_candle_patterns(spark, d):
    p = market.candle_patterns(candles(spark, d), K, O).select("symbol", F.explode("patterns").alias("pattern"))
    some = ["doji", "bullish_engulfing", "bearish_engulfing", "three_white_soldiers", "marubozu", "evening_star"]
    return p.filter(F.col("pattern").isin(some)).groupBy("symbol", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_quantity AS range, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY ALL")
def series_counts_by_range(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("range")).agg(F.sum("l_linenumber").alias("n"))
