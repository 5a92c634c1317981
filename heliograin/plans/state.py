"""State-kernel queries (recurrences over ordered events) and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.plans.base import CANDLES, EVENTS, candles, events, query, rounded
from heliograin.streaming import events as windows
from heliograin.streaming import kernels

ORDERED = f"{EVENTS}, o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM events_t)"


def recursion(state: dict[str, tuple[str, str]], out: str, rows: str = ORDERED, key: tuple[str, ...] = ("user_id", "event_id"), start: int = 1, before: str = "") -> str:
    """SQL of a kernel over rows ``o``: the state's columns at each series' row ``start`` and after each next row.

    A next value reads the row as o, the state before as r and columns set before it with an underscore added.
    ``before`` gives the outputs of rows before ``start``.
    """
    names = ", ".join(f"o.{k} AS {k}" for k in key)
    first, then = (", ".join(f"{x[j]} AS {n}{'_' * j}" for n, x in state.items()) for j in (0, 1))
    early = f" UNION ALL SELECT {', '.join(key)}, {before} FROM o WHERE i < {start}" if before else ""
    return (
        f"WITH RECURSIVE {rows}, r AS (SELECT {names}, o.i AS i, {first} FROM o WHERE i = {start} UNION ALL SELECT {names}, o.i AS i_, {then} FROM r JOIN o ON o.{key[0]} = r.{key[0]} AND o.i = r.i + 1) "
        f"SELECT {', '.join(key)}, {out} FROM r{early}"
    )


def _run(spark, d, kernel, digits=4):
    return rounded(kernels.in_batch(events(spark, d), "user_id", ["t", "event_id"], "value", kernel, ["event_id"]), digits)


@query(f"WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, i, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, r.ema + (1::DOUBLE / 7) * (o.value - r.ema) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, event_id, round(ema, 4) AS ema FROM r")
def state_ema(spark, d):
    return _run(spark, d, kernels.ema(1 / 7))


@query(
    f"WITH RECURSIVE {ORDERED}, s AS (SELECT user_id, event_id, i, value, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS 4 PRECEDING) AS m FROM o), r AS (SELECT user_id, event_id, i, m AS ema FROM s WHERE i = 5 UNION ALL SELECT s.user_id, s.event_id, s.i, r.ema + 2.0 / 6 * (s.value - r.ema) FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) "
    "SELECT user_id, event_id, round(ema, 4) AS ema FROM r UNION ALL SELECT user_id, event_id, NULL FROM o WHERE i < 5"
)
def state_seeded_ema(spark, d):
    return _run(spark, d, kernels.seeded_ema(5))


@query(
    f"WITH RECURSIVE {ORDERED}, s AS (SELECT user_id, event_id, i, value, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS 4 PRECEDING) AS m FROM o), r AS (SELECT user_id, event_id, i, m AS w FROM s WHERE i = 5 UNION ALL SELECT s.user_id, s.event_id, s.i, (r.w * 4 + s.value) / 5 FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) "
    "SELECT user_id, event_id, round(w, 4) AS wilder FROM r UNION ALL SELECT user_id, event_id, NULL FROM o WHERE i < 5"
)
def state_wilder(spark, d):
    return _run(spark, d, kernels.wilder(5))


@query(
    f"WITH RECURSIVE {ORDERED}, g AS (SELECT user_id, event_id, i - 1 AS i, greatest(value - p, 0) AS up, greatest(p - value, 0) AS dn FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS p FROM o) WHERE p IS NOT NULL), s AS (SELECT *, avg(up) OVER w AS mu, avg(dn) OVER w AS md FROM g WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS 4 PRECEDING)), "
    "r AS (SELECT user_id, event_id, i, mu AS u, md AS v FROM s WHERE i = 5 UNION ALL SELECT s.user_id, s.event_id, s.i, (r.u * 4 + s.up) / 5, (r.v * 4 + s.dn) / 5 FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) "
    "SELECT user_id, event_id, CASE WHEN v <= 1e-12 THEN 100.0 ELSE round(100 - 100 / (1 + u / v), 4) END AS rsi FROM r UNION ALL SELECT user_id, event_id, NULL FROM o WHERE i <= 5"
)
def state_rsi(spark, d):
    return _run(spark, d, kernels.rsi(5))


@query(
    f"WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, i, greatest(0, value - 50 - 5) AS hi, greatest(0, 50 - value - 5) AS lo, CASE WHEN greatest(0, value - 50 - 5) > 60 THEN 1.0 WHEN greatest(0, 50 - value - 5) > 60 THEN -1.0 ELSE 0.0 END::DOUBLE AS signal FROM o WHERE i = 1 "
    "UNION ALL SELECT user_id, event_id, i, hi, lo, CASE WHEN hi > 60 THEN 1.0 WHEN lo > 60 THEN -1.0 ELSE 0.0 END::DOUBLE FROM (SELECT o.user_id, o.event_id, o.i, greatest(0, CASE WHEN r.signal > 0 THEN 0 ELSE r.hi END + o.value - 50 - 5) AS hi, greatest(0, CASE WHEN r.signal < 0 THEN 0 ELSE r.lo END + 50 - o.value - 5) AS lo FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)) "
    "SELECT user_id, event_id, round(hi, 4) AS high, round(lo, 4) AS low, signal FROM r"
)
def state_cusum(spark, d):
    return _run(spark, d, kernels.cusum(50.0, 5.0, 60.0))


@query(
    recursion(
        {
            "c": ("1", "r.n + 1"), "m": ("o.value", "r.mean + (o.value - r.mean) / c_"), "s": ("-0.5::DOUBLE", "r.total + o.value - m_ - 0.5"), "b": ("-0.5::DOUBLE", "least(r.low, s_)"),
            "dev": ("0.0::DOUBLE", "s_ - b_"), "signal": ("0.0::DOUBLE", "(c_ >= 10 AND s_ - b_ > 50)::INT::DOUBLE"),
            "n": ("1", "CASE WHEN signal_ > 0 THEN 0 ELSE c_ END"), "mean": ("o.value", "CASE WHEN signal_ > 0 THEN 0 ELSE m_ END"), "total": ("-0.5::DOUBLE", "CASE WHEN signal_ > 0 THEN 0 ELSE s_ END"), "low": ("-0.5::DOUBLE", "CASE WHEN signal_ > 0 THEN 0 ELSE b_ END"),
        },
        "round(dev, 7) + 0.0 AS deviation, signal",
    )
)
def state_page_hinkley(spark, d):
    return _run(spark, d, kernels.page_hinkley(0.5, 50.0, 10), 7)


@query(
    f"WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, i, 0.2 * value + 0.8 * 50 AS e FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, 0.2 * o.value + 0.8 * r.e FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1), l AS (SELECT *, 3 * 30 * sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * i))) AS lim FROM r) "
    "SELECT user_id, event_id, round(e, 4) AS ewma, round(lim, 4) AS \"limit\", (abs(e - 50) > lim)::INT::DOUBLE AS signal FROM l"
)
def state_ewma_chart(spark, d):
    return _run(spark, d, kernels.ewma_chart(50.0, 30.0, 0.2, 3.0))


@query(
    recursion(
        {"fit": ("NULL::DOUBLE", "CASE WHEN o.i = 2 THEN NULL ELSE r.level + r.trend END"), "level": ("o.value", "CASE WHEN o.i = 2 THEN o.value ELSE 0.5 * o.value + 0.5 * fit_ END"), "trend": ("0.0::DOUBLE", "CASE WHEN o.i = 2 THEN o.value - r.level ELSE 0.3 * (level_ - r.level) + 0.7 * r.trend END")},
        "round(level + 1e-9, 7) AS level, round(trend + 1e-9, 7) + 0.0 AS trend, round(fit + 1e-9, 7) AS fitted",
    )
)
def state_holt(spark, d):
    # halves end on a 5 at any digit: a bit more makes both sides round alike
    h = kernels.in_batch(events(spark, d), "user_id", ["t", "event_id"], "value", kernels.holt(0.5, 0.3), ["event_id"])
    return rounded(h.withColumns({c: F.col(c) + 1e-9 for c in ("level", "trend", "fitted")}), 7)


@query(
    recursion(
        {
            "fit": ("NULL::DOUBLE", "r.level + r.trend + r.seasonal[(o.i - 1) % 7 + 1]"), "level": ("list_avg(o.first)", "0.4 * (o.value - r.seasonal[(o.i - 1) % 7 + 1]) + 0.6 * (r.level + r.trend)"), "trend": ("0.0::DOUBLE", "0.2 * (level_ - r.level) + 0.8 * r.trend"),
            "seasonal": ("list_transform(o.first, lambda x: x - list_avg(o.first))", "list_transform(range(1, 8), lambda k: CASE WHEN k = (o.i - 1) % 7 + 1 THEN 0.3 * (o.value - level_) + 0.7 * r.seasonal[k] ELSE r.seasonal[k] END)"),
        },
        "round(level, 4) AS level, round(fit, 4) AS fitted",
        f"{ORDERED.replace('o AS (', 'o0 AS (')}, o AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY i ROWS 6 PRECEDING) AS first FROM o0)",
        start=7,
        before="NULL, NULL",
    )
)
def state_holt_winters(spark, d):
    return _run(spark, d, kernels.holt_winters(0.4, 0.2, 0.3, 7))


@query(
    recursion({"p1": ("0.0::DOUBLE", "r.p + 1"), "level": ("o.value", "r.level + p1_ / (p1_ + 25) * (o.value - r.level)"), "p": ("25.0::DOUBLE", "(1 - p1_ / (p1_ + 25)) * p1_")}, "round(level, 4) AS level")
)
def state_kalman(spark, d):
    return _run(spark, d, kernels.kalman(1.0, 25.0))


@query(
    recursion({"health": ("least(greatest(o.value / 100, 0), 1)", "0.3 * least(greatest(o.value / 100, 0), 1) + 0.7 * r.health")}, "round(health, 4) AS health")
)
def state_health_index(spark, d):
    return _run(spark, d, kernels.health_index(0.0, 100.0, 0.3))


@query(
    recursion(
        {
            "t": ("o.value", "greatest(r.top, o.value)"), "whole": ("false", "r.n = 4"), "hit": ("0.0::DOUBLE", "coalesce(whole_ AND t_ > 1.5 * r.mean, false)::INT::DOUBLE"), "shown": ("NULL::DOUBLE", "CASE WHEN whole_ THEN t_ END"),
            "top": ("o.value", "CASE WHEN whole_ THEN '-infinity'::DOUBLE ELSE t_ END"), "n": ("1", "CASE WHEN whole_ THEN 0 ELSE r.n + 1 END"), "mean": ("NULL::DOUBLE", "CASE WHEN NOT whole_ THEN r.mean WHEN r.mean IS NULL THEN t_ ELSE r.mean + 0.2 * (t_ - r.mean) END"),
        },
        "round(shown, 4) AS window_max, hit AS spike",
    )
)
def state_spikes(spark, d):
    return _run(spark, d, kernels.spikes(5, 0.2, 1.5))


@query(
    f"WITH {CANDLES}, x AS (SELECT symbol, day, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w AS i FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT symbol, day, round(avg(tr) OVER (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING), 4) AS wilder FROM x QUALIFY i = 5"
)
def state_average_true_range_seed(spark, d):
    from pyspark.sql import Window as W

    from heliograin.operators.windows import Series

    c = candles(spark, d).withColumns({"tr": Series(["symbol"], ["day"]).true_range("high", "low", "close"), "i": F.row_number().over(W.partitionBy("symbol").orderBy("day"))})
    return rounded(kernels.in_batch(c, "symbol", ["day"], "tr", kernels.wilder(5), ["day", "i"]).filter("i = 5").select("symbol", "day", "wilder"))


WINDOWS = f"{ORDERED}, x AS (SELECT user_id, value, i - 1 AS i, unnest(range(greatest(ceil((i - 1 - 4 + 1) / 2)::BIGINT, 0), (i - 1) // 2 + 1)) AS \"window\" FROM o), w AS (SELECT user_id, \"window\", min(i) AS start, count(*) AS n, round(sum(value), 4) AS sum, max(value) AS max FROM x GROUP BY ALL HAVING count(*) = 4)"


@query(f"WITH {WINDOWS} SELECT user_id, \"window\", start, n, sum, round(max, 4) AS max FROM w")
def state_count_windows(spark, d):
    return rounded(windows.count_windows(events(spark, d), ["user_id"], ["t", "event_id"], "value", 4, 2))


@query(f"WITH {WINDOWS} SELECT user_id, start, row_number() OVER (PARTITION BY user_id ORDER BY \"window\") - 1 AS event_id FROM w WHERE sum >= 250")
def state_detections(spark, d):
    w = rounded(windows.count_windows(events(spark, d), ["user_id"], ["t", "event_id"], "value", 4, 2))
    return windows.detect(w, ["user_id"], F.when(F.col("sum") >= 250, 1.0).otherwise(0.0)).select("user_id", "start", F.col("event_id").cast("long").alias("event_id"))


@query("SELECT user_id, round(arg_max(value, (ts, event_id)) FILTER (event_type <> 'error'), 4) AS value FROM events GROUP BY ALL")
def state_latest_good(spark, d):
    e = events(spark, d)
    return rounded(windows.latest(e, ["user_id"], "t", "event_id", "value", F.col("event_type") != "error"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def state_bounded_log(spark, d):
    return windows.bounded_log(events(spark, d), "t", "event_id", 100).select("event_id")


@query("SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 BETWEEN 1704500000 AND 1704800000")
def state_range_scan(spark, d):
    return windows.between(events(spark, d), "t", 1704500000, 1704800000).select("event_id")


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS sum FROM events GROUP BY ALL")
def state_hourly(spark, d):
    h = windows.hourly(events(spark, d), "ts", ["event_type"], "value")
    return rounded(h.withColumn("start", F.unix_seconds("start")))


@query(
    "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS ch FROM events), s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t, ch ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, min(t)::BIGINT AS start, (max(t) + 1800000000)::BIGINT AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"
)
def state_sessions(spark, d):
    s = windows.sessions(events(spark, d), "ts", "user_id")
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(
    recursion({"a": ("0.1 + 0.02 * (0.1 - (o.value > 90)::INT)::DOUBLE", "r.a + 0.02 * (0.1 - (o.value > 90)::INT)::DOUBLE")}, "round(least(greatest(a, 0), 1), 4) + 0.0 AS alpha")
)
def state_adaptive_alpha(spark, d):
    e = events(spark, d).withColumn("miss", (F.col("value") > 90).cast("double"))
    return rounded(kernels.in_batch(e, "user_id", ["t", "event_id"], "miss", kernels.adaptive_alpha(0.1, 0.02), ["event_id"]))
