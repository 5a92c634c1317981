"""Market queries over daily candles and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import market
from heliograin.plans.base import CANDLES, candles, query, rounded, table

K, O = ["symbol"], ["day"]
RET = f"{CANDLES}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM candles)"


def _returns(spark, d):
    return market.returns(candles(spark, d), K, O, "close")


@query(f"WITH {RET} SELECT symbol, day, round(ret, 6) AS ret FROM r")
def market_returns(spark, d):
    return rounded(_returns(spark, d).select("symbol", "day", "ret"), 6)


@query(
    f"WITH {RET} SELECT symbol, count(ret) AS n, round(stddev_samp(ret) * sqrt(252), 4) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 4) AS sharpe, "
    "round(avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252), 4) AS sortino, round(avg(ret) / var_samp(ret), 4) AS kelly FROM r WHERE ret IS NOT NULL GROUP BY ALL"
)
def market_performance(spark, d):
    return rounded(market.performance(_returns(spark, d), K, "ret", 252.0))


@query(f"WITH {CANDLES}, p AS (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM candles) SELECT symbol, round(max((peak - close) / peak), 6) AS max_drawdown, round(sqrt(avg(((peak - close) / peak) ** 2 * 10000)), 4) AS ulcer_index FROM p GROUP BY ALL")
def market_drawdown(spark, d):
    r = market.drawdown(candles(spark, d), K, O, "close")
    return rounded(r.withColumn("max_drawdown", F.round("max_drawdown", 6)), 6).withColumn("ulcer_index", F.round("ulcer_index", 4))


@query(f"WITH {RET}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL) SELECT symbol, round(-max(ret), 6) AS value_at_risk, round(-avg(ret), 6) AS expected_shortfall FROM k WHERE i <= ceil(n * 0.05) GROUP BY ALL")
def market_tail_risk(spark, d):
    return rounded(market.tail_risk(_returns(spark, d), K, "ret", 0.05), 6)


@query(
    f"WITH {RET}, a AS (SELECT symbol, count(ret) AS n, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret < 0) AS losses, sum(ret) FILTER (ret > 0) AS p, -sum(ret) FILTER (ret < 0) AS l FROM r WHERE ret IS NOT NULL GROUP BY ALL) "
    "SELECT symbol, n, wins, losses, round(p / l, 4) AS profit_factor, round(wins / n * p / wins - losses / n * l / losses, 4) AS expectancy FROM a"
)
def market_trade_stats(spark, d):
    return rounded(market.trade_stats(_returns(spark, d).filter("ret is not null"), K, "ret"))


@query(
    f"WITH {CANDLES}, q AS (SELECT *, lag(low) OVER w AS bl, lag(open) OVER w AS bs, lag(high) OVER w AS al, lag(volume) OVER w AS asz FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY day)) "
    "SELECT symbol, round(sum(CASE WHEN low >= bl THEN open ELSE 0 END - CASE WHEN low <= bl THEN bs ELSE 0 END - (CASE WHEN high <= al THEN volume ELSE 0 END - CASE WHEN high >= al THEN asz ELSE 0 END)), 2) AS ofi FROM q WHERE bl IS NOT NULL GROUP BY ALL"
)
def market_order_flow(spark, d):
    return rounded(market.order_flow(candles(spark, d), K, O, "low", "open", "high", "volume"), 2)


@query("SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END) / sum(l_quantity), 6) AS imbalance FROM lineitem GROUP BY ALL")
def market_trade_imbalance(spark, d):
    return rounded(market.trade_imbalance(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "R"), 6)


@query(
    f"WITH {CANDLES}, v AS (SELECT symbol, greatest(close - open, 0) / 1000 AS b, greatest(open - close, 0) / 1000 AS s, sum((greatest(close - open, 0) / 1000) + (greatest(open - close, 0) / 1000)) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS e FROM candles), "
    "p AS (SELECT symbol, b, s, b + s AS v, e, unnest(range(floor((e - b - s) / 500)::BIGINT, greatest(ceil(e / 500)::BIGINT - 1, floor((e - b - s) / 500)::BIGINT) + 1)) AS k FROM v WHERE b + s > 0), "
    "q AS (SELECT symbol, k, sum((b - s) * (least(e, (k + 1) * 500) - greatest(e - v, k * 500)) / v) AS i, sum(v * (least(e, (k + 1) * 500) - greatest(e - v, k * 500)) / v) AS t FROM p GROUP BY ALL HAVING t >= 500 * (1 - 1e-9)) SELECT symbol, round(avg(abs(i) / 500), 4) AS vpin, count(*) AS buckets FROM q GROUP BY ALL"
)
def market_vpin(spark, d):
    c = candles(spark, d).withColumns({"b": F.greatest(F.col("close") - F.col("open"), F.lit(0.0)) / 1000, "s": F.greatest(F.col("open") - F.col("close"), F.lit(0.0)) / 1000})
    return rounded(market.vpin(c, K, O, "b", "s", 500.0))


@query(f"WITH {RET} SELECT symbol, round(covar_pop(close - open, volume) / var_pop(volume), 4) AS kyle_lambda FROM r GROUP BY ALL")
def market_kyle_lambda(spark, d):
    return rounded(market.kyle_lambda(candles(spark, d).withColumn("dp", F.col("close") - F.col("open")), K, "dp", "volume"))


BOOK = "levels AS (SELECT l_suppkey % 30 AS book, CASE WHEN l_returnflag = 'R' THEN 'ask' ELSE 'bid' END AS side, round(CASE WHEN l_returnflag = 'R' THEN 100 + l_discount ELSE 100 - l_tax END, 2) AS price, sum(l_quantity)::DOUBLE AS size FROM lineitem GROUP BY ALL)"


def _levels(spark, d):
    li = table(spark, d, "lineitem")
    ask = F.col("l_returnflag") == "R"
    return li.groupBy((F.col("l_suppkey") % 30).alias("book"), F.when(ask, "ask").otherwise("bid").alias("side"), F.round(F.when(ask, 100 + F.col("l_discount")).otherwise(100 - F.col("l_tax")), 2).alias("price")).agg(
        F.sum("l_quantity").cast("double").alias("size")
    )


@query(
    f"WITH {BOOK}, b AS (SELECT book, max(price) FILTER (side = 'bid') AS bp, min(price) FILTER (side = 'ask') AS ap, arg_max(size, price) FILTER (side = 'bid') AS bs, arg_min(size, price) FILTER (side = 'ask') AS sz, sum(size) FILTER (side = 'bid') AS bd, sum(size) FILTER (side = 'ask') AS ad FROM levels GROUP BY ALL) "
    "SELECT book, bp AS best_bid, ap AS best_ask, round((bp + ap) / 2, 4) AS mid, round((bp * sz + ap * bs) / (bs + sz), 4) AS micro_price, round(ap - bp, 4) AS spread, round(10000 * (ap - bp) / ((bp + ap) / 2), 4) AS spread_bps, round((bd - ad) / (bd + ad), 4) AS imbalance FROM b"
)
def market_book_metrics(spark, d):
    return rounded(market.book_metrics(_levels(spark, d), ["book"], "side", "price", "size"))


@query(
    f"WITH {BOOK}, u AS (SELECT book, price, size, sum(size) OVER (PARTITION BY book ORDER BY price, size ROWS UNBOUNDED PRECEDING) AS e FROM levels WHERE side = 'ask'), t AS (SELECT book, price, greatest(least(e, 5000) - (e - size), 0) AS q FROM u) SELECT book, round(sum(price * q) / sum(q), 4) AS vwap, sum(q) AS filled FROM t GROUP BY ALL"
)
def market_fill_cost(spark, d):
    return rounded(market.fill_cost(_levels(spark, d).filter("side = 'ask'"), ["book"], "price", "size", 5000.0))


@query(f"WITH {CANDLES} SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(covar_pop(x.close, y.close) / var_pop(x.close), 4) AS hedge_ratio, round(corr(x.close, y.close), 4) AS correlation FROM candles x JOIN candles y ON x.day = y.day AND x.symbol < y.symbol GROUP BY ALL")
def market_pairs(spark, d):
    return rounded(market.pair_regressions(candles(spark, d), "day", "symbol", "close"))


@query(f"WITH {CANDLES}, l AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS p FROM candles), s AS (SELECT symbol, count(*) AS n, covar_pop(close - p, p) / var_pop(p) AS slope FROM l WHERE p IS NOT NULL GROUP BY ALL) SELECT symbol, n, round(slope, 4) AS slope, CASE WHEN slope < 0 THEN round(-ln(2) / slope, 4) END AS half_life FROM s")
def market_mean_reversion(spark, d):
    return rounded(market.mean_reversion(candles(spark, d), K, O, "close"))


def _cov(pairs):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance, round(corr({a}, {b}), 4) AS correlation FROM lineitem" for a, b in pairs)


@query(_cov([(a, b) for i, a in enumerate(("l_quantity", "l_discount", "l_tax")) for b in ("l_quantity", "l_discount", "l_tax")[i:]]))
def market_correlations(spark, d):
    return rounded(market.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query(f"WITH {RET}, v AS (SELECT symbol, 1 / stddev_samp(ret) AS w FROM r GROUP BY ALL) SELECT symbol, round(w / sum(w) OVER (), 6) AS weight FROM v")
def market_inverse_risk_weights(spark, d):
    return rounded(market.inverse_risk_weights(_returns(spark, d), "symbol", "ret"), 6)


@query(f"WITH {CANDLES} SELECT symbol, day, round(10000 * (volume - 100) * (volume > 100)::INT / sum((volume - 100) * (volume > 100)::INT) OVER (PARTITION BY symbol), 6) + 0.0 AS child FROM candles")
def market_schedule(spark, d):
    return rounded(market.schedule(candles(spark, d), K, F.col("volume") - 100, 10000.0).select("symbol", "day", "child"), 6)


@query(
    f"WITH {RET}, i AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i FROM r WHERE ret IS NOT NULL), b AS (SELECT symbol, n, i // n AS b, i, ret, ret - avg(ret) OVER (PARTITION BY symbol, n, i // n) AS dv FROM i, (SELECT unnest([8, 16, 32, 64]) AS n)), "
    "s AS (SELECT *, sum(dv) OVER (PARTITION BY symbol, n, b ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM b), q AS (SELECT symbol, n, b, (max(s) - min(s)) / stddev_pop(ret) AS rs FROM s GROUP BY ALL HAVING count(*) = n AND stddev_pop(ret) > 0), m AS (SELECT symbol, n, avg(rs) AS rs FROM q GROUP BY ALL) "
    "SELECT symbol, round(covar_pop(ln(rs), ln(n)) / var_pop(ln(n)), 6) AS hurst FROM m GROUP BY ALL"
)
def market_hurst(spark, d):
    return rounded(market.hurst(_returns(spark, d).filter("ret is not null"), K, O, "ret", [8, 16, 32, 64]), 6)
