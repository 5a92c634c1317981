"""Monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import monitoring
from heliograin.plans.state import ORDERED, recursion
from heliograin.plans.base import CANDLES, EVENTS, candles, events, query, rounded, table
from heliograin.streaming import kernels


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 1000 < 2.3 THEN 'A' WHEN s_acctbal / 1000 < 4.5 THEN 'B' WHEN s_acctbal / 1000 < 7.1 THEN 'C' ELSE 'D' END AS zone FROM supplier")
def monitoring_vibration_zones(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", monitoring.vibration_zone(F.col("s_acctbal") / 1000, 1, "rigid").alias("zone"))


@query(
    f"WITH {CANDLES}, h AS (SELECT symbol, day, (day - 8000)::DOUBLE AS t, close / 1000 AS h FROM candles), s AS (SELECT symbol, day, t, count(*) OVER w AS n, covar_pop(t, h) OVER w / var_pop(t) OVER w AS s, avg(h) OVER w AS mh, avg(t) OVER w AS mt FROM h WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 9 PRECEDING)) "
    "SELECT symbol, day, CASE WHEN n >= 2 THEN round(CASE WHEN s IS NULL OR s >= 0 THEN 100000.0 ELSE greatest(-(mh - s * mt) / s - t, 0) END, 3) END AS rul FROM s"
)
def monitoring_remaining_life(spark, d):
    c = candles(spark, d).withColumns({"t": (F.col("day") - 8000).cast("double"), "h": F.col("close") / 1000})
    return rounded(monitoring.remaining_life(c, ["symbol"], ["day"], "t", "h", 10).select("symbol", "day", "rul"), 3)


@query(
    "WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, var_samp(l_quantity) AS a, var_samp(l_discount) AS b, covar_samp(l_quantity, l_discount) AS c FROM lineitem), t AS (SELECT l_returnflag, (b * (l_quantity - ma) ** 2 - 2 * c * (l_quantity - ma) * (l_discount - mb) + a * (l_discount - mb) ** 2) / (a * b - c * c) AS t2 FROM lineitem, m) "
    "SELECT l_returnflag, round(max(t2), 4) AS worst, count(*) FILTER (t2 > 5) AS n_out FROM t GROUP BY ALL"
)
def monitoring_hotelling(spark, d):
    li = table(spark, d, "lineitem")
    t = monitoring.hotelling(li, li, ["l_quantity", "l_discount"], 5.0)
    return rounded(t.groupBy("l_returnflag").agg(F.max("t2").alias("worst"), F.count(F.when(F.col("out"), 1)).alias("n_out")))


# of three columns the residual of two components lies along the eigenvector of the least eigenvalue, which has a closed form
@query(
    "WITH x AS (SELECT l_returnflag, l_quantity / 50 AS x, l_discount * 5 AS y, l_tax * 5 AS z FROM lineitem), s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM x), "
    "q AS (SELECT *, (a + b + c) / 3 AS q FROM s), p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q), "
    "r AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3) AS r FROM p), l AS (SELECT *, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l FROM r), "
    "v AS (SELECT *, d * f - e * (b - l) AS vx, e * d - (a - l) * f AS vy, (a - l) * (b - l) - d * d AS vz FROM l), t AS (SELECT l_returnflag, ((x - mx) * vx + (y - my) * vy + (z - mz) * vz) ** 2 / (vx * vx + vy * vy + vz * vz) AS spe FROM x, v) "
    "SELECT l_returnflag, round(max(spe), 8) AS worst, round(avg(spe), 8) AS mean FROM t GROUP BY ALL"
)
def monitoring_principal_components(spark, d):
    li, columns = table(spark, d, "lineitem"), ["x", "y", "z"]
    li = li.select("l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 5).alias("y"), (F.col("l_tax") * 5).alias("z"))
    spe = monitoring.residual_error(li, columns, monitoring.principal_components(li, columns, 2))
    return rounded(spe.groupBy("l_returnflag").agg(F.max("spe").alias("worst"), F.avg("spe").alias("mean")), 8)


@query(
    "WITH g AS (SELECT o_orderkey // 5 AS g, count(*) AS n, avg(o_totalprice) AS m, max(o_totalprice) - min(o_totalprice) AS r FROM orders GROUP BY ALL HAVING n = 5), a AS (SELECT avg(m) AS c, avg(r) AS r FROM g) "
    "SELECT round(c, 2) AS centre, round(c - 3 / (2.326 * sqrt(5)) * r, 2) AS mean_low, round(c + 3 / (2.326 * sqrt(5)) * r, 2) AS mean_high, round(greatest(0, 1 - 3 * 0.864 / 2.326) * r, 2) AS range_low, round((1 + 3 * 0.864 / 2.326) * r, 2) AS range_high FROM a"
)
def monitoring_control_limits(spark, d):
    o = table(spark, d, "orders").withColumn("g", F.floor(F.col("o_orderkey") / 5))
    return rounded(monitoring.control_limits(o, ["g"], "o_totalprice", 5), 2)


@query("SELECT o_orderkey // 1000 AS \"window\", round(avg(abs(o_totalprice - 150000)) / 70000, 6) AS ratio, avg(abs(o_totalprice - 150000)) / 70000 > 1.05 AS drift FROM orders GROUP BY ALL")
def monitoring_model_drift(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.lit(150000.0))
    return rounded(monitoring.model_drift(o, F.floor(F.col("o_orderkey") / 1000), "o_totalprice", "p", 70000.0, 1.05), 6)


@query(
    "WITH a AS (SELECT count(*) AS n, avg(abs(l_extendedprice - l_quantity * 1000)) AS current, avg(abs(l_extendedprice - l_quantity * 1500)) AS candidate FROM lineitem) SELECT n, round(current, 4) AS current, round(candidate, 4) AS candidate, CASE WHEN candidate < current * 0.98 THEN 'promote' WHEN candidate > current * 1.02 THEN 'keep' ELSE 'inconclusive' END AS decision FROM a"
)
def monitoring_shadow_decision(spark, d):
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_quantity") * 1000, "b": F.col("l_quantity") * 1500})
    return rounded(monitoring.shadow_decision(li, "l_extendedprice", "a", "b", 0.02, 100))


@query("WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc, count(*) AS n FROM lineitem) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS partial_correlation, n FROM r")
def monitoring_partial_correlation(spark, d):
    return rounded(monitoring.partial_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"), 6)


@query("SELECT l_returnflag, round(sum(l_linenumber * (l_quantity / 10) ** 3 / 1e6), 6) AS damage FROM lineitem GROUP BY ALL")
def monitoring_miner_damage(spark, d):
    li = table(spark, d, "lineitem").withColumn("s", F.col("l_quantity") / 10)
    return rounded(monitoring.miner_damage(li, ["l_returnflag"], "s", "l_linenumber", 1e6, 3.0), 6)


@query("SELECT p_partkey, round(p_size * 4 * (1 - 0.2::DOUBLE), 6) AS bpfo, round(p_size * 4 * (1 + 0.2::DOUBLE), 6) AS bpfi, round(p_size * 2.5::DOUBLE * (1 - 0.04::DOUBLE), 6) AS bsf, round(p_size * (1 - 0.2::DOUBLE) / 2, 6) AS ftf FROM part")
def monitoring_bearing_frequencies(spark, d):
    f = monitoring.bearing_frequencies(F.col("p_size"), 8, 10.0, 50.0)
    return rounded(table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in f.items()]), 6)


@query(
    f"WITH {EVENTS}, e AS (SELECT user_id, (t - 1704067200) / 86400 AS t, value - avg(value) OVER (PARTITION BY user_id) AS y, var_pop(value) OVER (PARTITION BY user_id) AS v FROM events_t), x AS (SELECT *, f, 2 * pi() * f AS w FROM e, (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS f) WHERE v > 0), "
    "a AS (SELECT user_id, f, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / 2 AS p FROM x GROUP BY ALL), c AS (SELECT x.*, cos(w * t - p) AS c, sin(w * t - p) AS s FROM x JOIN a USING (user_id, f)) "
    "SELECT user_id, f AS frequency, round((sum(y * c) ** 2 / sum(c * c) + sum(y * s) ** 2 / sum(s * s)) / (2 * any_value(v)), 4) AS power FROM c GROUP BY ALL"
)
def monitoring_lomb_scargle(spark, d):
    e = events(spark, d).withColumn("t", (F.col("t") - 1704067200) / 86400)
    return rounded(monitoring.lomb_scargle(e, ["user_id"], "t", "value", [0.5, 1.0, 2.0]))


@query(
    f"WITH {CANDLES}, m AS (SELECT symbol, day, close, CASE WHEN count(*) OVER w20 = 20 THEN sign(avg(close) OVER w5 - avg(close) OVER w20) ELSE 0 END AS pos FROM candles WINDOW w5 AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)), "
    "p AS (SELECT symbol, pos, coalesce(lag(pos) OVER w * (close - lag(close) OVER w), 0) AS pnl FROM m WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT symbol, count(*) FILTER (pos > 0) AS long_days, round(sum(pnl), 2) AS pnl FROM p GROUP BY ALL"
)
def monitoring_crossing_strategy(spark, d):
    s = monitoring.crossing_strategy(candles(spark, d), ["symbol"], ["day"], "close", 5, 20)
    return rounded(s.groupBy("symbol").agg(F.count(F.when(F.col("position") > 0, 1)).alias("long_days"), F.sum("pnl").alias("pnl")), 2)


@query("SELECT CASE WHEN regexp_matches(p, '^(GET|POST|PUT|HEAD|DELETE|OPTIONS|HTTP/)') THEN 'http' WHEN regexp_matches(p, '^SSH-') THEN 'ssh' WHEN regexp_matches(p, '^(EHLO|HELO|220 )') THEN 'smtp' ELSE 'unknown' END AS protocol, count(*) AS n FROM (SELECT ['GET /', 'SSH-2.0', 'EHLO x', 'zzz'][event_id % 4 + 1] AS p FROM events) GROUP BY ALL")
def monitoring_payload_protocols(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("GET /", "SSH-2.0", "EHLO x", "zzz"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").groupBy(monitoring.payload_protocol(p).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


BARS = f"{CANDLES}, o AS (SELECT *, row_number() OVER w AS i, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY day))"


def mean_of(name: str, rows: str, value: str, n: int, step: str) -> str:
    """SQL of a running mean ``name`` (symbol, i, v) of rows (symbol, i): the plain mean of the first n values, then ``step`` of r.v and s.x."""
    return (
        f"{name}_x AS (SELECT symbol, i, {value} AS x, avg({value}) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING) AS m FROM {rows}), "
        f"{name} AS (SELECT symbol, i, m AS v FROM {name}_x WHERE i = {n} UNION ALL SELECT s.symbol, s.i, {step} FROM {name} r JOIN {name}_x s ON s.symbol = r.symbol AND s.i = r.i + 1)"
    )


def seeded_of(name: str, rows: str, value: str, n: int) -> str:
    return mean_of(name, rows, value, n, f"r.v + 2.0::DOUBLE / {n + 1} * (s.x - r.v)")


def wilder_of(name: str, rows: str, value: str, n: int) -> str:
    return mean_of(name, rows, value, n, f"(r.v * {n - 1} + s.x) / {n}")


def _bars(spark, d, kernel):
    return rounded(kernels.in_batch(candles(spark, d), "symbol", ["day"], ["high", "low", "close"], kernel))


@query(
    f"WITH RECURSIVE {BARS}, {seeded_of('fast', 'o', 'close', 12)}, {seeded_of('slow', 'o', 'close', 26)}, line AS (SELECT symbol, i - 25 AS i, fast.v - slow.v AS x FROM fast JOIN slow USING (symbol, i)), {seeded_of('sig', 'line', 'x', 9)} "
    "SELECT o.symbol, o.day, round(line.x, 4) + 0.0 AS macd, round(sig.v, 4) + 0.0 AS signal FROM o LEFT JOIN line ON line.symbol = o.symbol AND line.i = o.i - 25 LEFT JOIN sig ON sig.symbol = o.symbol AND sig.i = o.i - 25"
)
def state_macd(spark, d):
    return rounded(kernels.in_batch(candles(spark, d), "symbol", ["day"], "close", kernels.macd(12, 26, 9)))


@query(
    f"WITH RECURSIVE {BARS}, {seeded_of('mid', 'o', 'close', 10)}, {wilder_of('atr', 'o', 'tr', 10)} "
    "SELECT o.symbol, o.day, round(mid.v - 2 * atr.v, 4) AS lower, round(mid.v, 4) AS middle, round(mid.v + 2 * atr.v, 4) AS upper FROM o LEFT JOIN mid ON mid.symbol = o.symbol AND mid.i = o.i LEFT JOIN atr ON atr.symbol = o.symbol AND atr.i = o.i"
)
def state_keltner(spark, d):
    return _bars(spark, d, kernels.keltner(10, 2.0))


@query(
    f"WITH RECURSIVE {BARS}, {wilder_of('atr', 'o', 'tr', 10)}, b AS (SELECT o.*, (high + low) / 2 + 3 * v AS top0, (high + low) / 2 - 3 * v AS bottom0 FROM o JOIN atr USING (symbol, i)), "
    "r AS (SELECT symbol, day, i, top0 AS top, bottom0 AS bottom, true AS up FROM b WHERE i = 10 UNION ALL SELECT b.symbol, b.day, b.i, CASE WHEN top0 < r.top OR pc > r.top THEN top0 ELSE r.top END AS top_, CASE WHEN bottom0 > r.bottom OR pc < r.bottom THEN bottom0 ELSE r.bottom END AS bottom_, "
    "CASE WHEN r.up THEN close >= bottom_ ELSE close > top_ END FROM r JOIN b ON b.symbol = r.symbol AND b.i = r.i + 1) "
    "SELECT symbol, day, round(CASE WHEN up THEN bottom ELSE top END, 4) AS band, CASE WHEN up THEN 1.0 ELSE -1.0 END::DOUBLE AS direction FROM r UNION ALL SELECT symbol, day, NULL, NULL FROM o WHERE i < 10"
)
def state_supertrend(spark, d):
    return _bars(spark, d, kernels.supertrend(10, 3.0))


@query(
    f"WITH RECURSIVE {BARS}, m AS (SELECT symbol, i - 1 AS i, tr, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS down FROM o WHERE i > 1), "
    f"{wilder_of('wu', 'm', 'up', 14)}, {wilder_of('wd', 'm', 'down', 14)}, {wilder_of('wr', 'm', 'tr', 14)}, di AS (SELECT symbol, i - 13 AS i, CASE WHEN wr.v > 1e-12 THEN 100 * wu.v / wr.v ELSE 0 END AS p, CASE WHEN wr.v > 1e-12 THEN 100 * wd.v / wr.v ELSE 0 END AS n FROM wu JOIN wd USING (symbol, i) JOIN wr USING (symbol, i)), "
    f"dx AS (SELECT *, CASE WHEN p + n > 1e-12 THEN 100 * abs(p - n) / (p + n) ELSE 0 END AS x FROM di), {wilder_of('wx', 'dx', 'x', 14)} "
    "SELECT o.symbol, o.day, round(dx.p, 4) AS plus_di, round(dx.n, 4) AS minus_di, round(wx.v, 4) AS adx FROM o LEFT JOIN dx ON dx.symbol = o.symbol AND dx.i = o.i - 14 LEFT JOIN wx ON wx.symbol = o.symbol AND wx.i = o.i - 14"
)
def state_directional(spark, d):
    return _bars(spark, d, kernels.directional(14))


@query(
    recursion(
        {
            "valid": ("false", "(o.st = r.a + 1 AND o.sq = 0) OR (o.st = r.a AND o.sq = r.b + 1)"), "verdict": ("0.0::DOUBLE", "CASE WHEN valid_ THEN 1.0 WHEN (o.st, o.sq) <= (r.a, r.b) THEN 2.0 ELSE 3.0 END::DOUBLE"),
            "a": ("o.st", "CASE WHEN valid_ THEN o.st ELSE r.a END"), "b": ("o.sq", "CASE WHEN valid_ THEN o.sq ELSE r.b END"),
        },
        "verdict",
        f"{ORDERED.replace('o AS (', 'o0 AS (')}, o AS (SELECT *, floor(value / 20) AS st, event_id % 3 AS sq FROM o0)",
    )
)
def state_sequence_monitor(spark, d):
    e = events(spark, d).withColumns({"st": F.floor(F.col("value") / 20), "sq": F.col("event_id") % 3})
    return kernels.in_batch(e, "user_id", ["t", "event_id"], ["st", "sq"], kernels.sequence_monitor(), ["event_id"])


@query(
    f"WITH {ORDERED}, h AS (SELECT *, avg((value < 80)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS 19 PRECEDING) AS c FROM o) SELECT user_id, event_id, round(c, 4) AS coverage, max((i >= 10 AND c < 0.6)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)::DOUBLE AS rollback FROM h"
)
def state_rollback_monitor(spark, d):
    e = events(spark, d).withColumn("hit", (F.col("value") < 80).cast("double"))
    return rounded(monitoring.rollbacks(e, ["user_id"], ["t", "event_id"], "hit", 20, 0.6, 10).select("user_id", "event_id", "coverage", "rollback"))


@query(
    recursion({"off": ("0.3 * (o.value - 50)", "0.3 * (o.value - r.recipe) + 0.7 * r.off"), "recipe": ("50 - 0.3 * (o.value - 50)", "50 - off_")}, "round(off, 4) + 0.0 AS offset, round(recipe, 4) + 0.0 AS recipe")
)
def state_run_to_run(spark, d):
    return rounded(kernels.in_batch(events(spark, d), "user_id", ["t", "event_id"], "value", kernels.run_to_run(50.0, 1.0, 0.3), ["event_id"]))


@query()
def state_rainflow(spark, d):
    return rounded(kernels.rainflow(candles(spark, d), "symbol", ["day"], "close"))


def _scan(fast: int, slow: int) -> str:
    return (
        f"(WITH m AS (SELECT symbol, day, close, CASE WHEN count(*) OVER b = {slow} THEN sign(avg(close) OVER a - avg(close) OVER b) ELSE 0 END AS pos FROM candles WINDOW a AS (PARTITION BY symbol ORDER BY day ROWS {fast - 1} PRECEDING), b AS (PARTITION BY symbol ORDER BY day ROWS {slow - 1} PRECEDING)), "
        "p AS (SELECT *, coalesce(lag(pos) OVER w * (close - lag(close) OVER w), 0) AS pnl, (pos <> coalesce(lag(pos) OVER w, 0))::INT AS turn, first(close) OVER w AS f FROM m WINDOW w AS (PARTITION BY symbol ORDER BY day)), "
        "e AS (SELECT *, f + sum(pnl) OVER (PARTITION BY symbol ORDER BY day) AS equity FROM p), k AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM e) "
        f"SELECT symbol, {fast} AS fast, {slow} AS slow, sum(pnl) / any_value(f) AS total_return, max((peak - equity) / peak) AS max_drawdown, sum(turn)::BIGINT AS trades FROM k GROUP BY ALL)"
    )


@query(
    f"WITH {CANDLES}, s AS (SELECT *, greatest(0, least(1, 0.5 + total_return / 2 - max_drawdown / 2)) AS score FROM ({_scan(5, 20)} UNION ALL {_scan(10, 30)} UNION ALL {_scan(20, 60)}) WHERE total_return >= -100 AND trades >= 3 AND max_drawdown <= 1000) "
    "SELECT symbol, fast, slow, round(total_return, 4) AS total_return, round(max_drawdown, 4) AS max_drawdown, trades, round(score, 4) AS score, "
    "sha256(concat_ws('|', symbol, fast, slow, round(total_return * 1e6)::BIGINT, round(max_drawdown * 1e6)::BIGINT, trades, round(score * 1e6)::BIGINT)) AS proof FROM s"
)
def monitoring_market_scan(spark, d):
    return rounded(monitoring.market_scan(candles(spark, d), "symbol", ["day"], "close", [(5, 20), (10, 30), (20, 60)], -100.0, 1000.0, 3))


@query(
    "WITH t AS (SELECT l_linenumber AS k, l_suppkey AS a FROM lineitem WHERE l_orderkey % 4 = 0), c AS (SELECT k, count(*) AS n FROM t GROUP BY ALL), sc AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS part, -log2((coalesce(c.n, 0) + 1) / ((SELECT count(*) FROM t) + 1)) + CASE WHEN l_suppkey IN (SELECT a FROM t) THEN 0 ELSE 8 END AS score FROM lineitem LEFT JOIN c ON l_linenumber = c.k WHERE l_orderkey % 4 < 3), "
    "q AS (SELECT quantile_cont(score, 0.9) AS bound FROM sc WHERE part = 1) SELECT l_linenumber AS k, count(*) AS n, count(*) FILTER (score > bound + 1e-9) AS alarms FROM sc, q WHERE part = 2 GROUP BY ALL"
)
def monitoring_protocol_baseline(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("a"))
    part = lambda n: li.filter(F.col("l_orderkey") % 4 == n).drop("l_orderkey")
    found = monitoring.baseline_alarms(part(0), part(1), part(2), "k", "a", 0.9)
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("alarm"), 1)).alias("alarms"))
