"""Market analytics: candles, returns and risk, microstructure, pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candles(df: DataFrame, keys: list[str], bucket: Column, price: str, volume: Column, order: list[str]) -> DataFrame:
    """Open, high, low, close, volume for each bucket: one aggregate, first and last by order."""
    at = F.struct(*order)
    return df.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume")
    )


def returns(df: DataFrame, keys: list[str], order: list[str], equity: str) -> DataFrame:
    """``df`` with ret: simple return, 0 from a base of (almost) 0, null in the first row."""
    before = F.lag(equity).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("ret", F.when(F.abs(before) > 1e-12, F.col(equity) / before - 1).when(before.isNotNull(), 0.0))


def performance(df: DataFrame, keys: list[str], ret: str, periods: float, target: float = 0.0) -> DataFrame:
    """Volatility, Sharpe and Sortino ratios, annualised; 0 where the denominator is (almost) 0."""
    r = F.col(ret)
    down = F.sqrt(F.avg(F.pow(F.least(r - target, F.lit(0.0)), F.lit(2.0))))
    a = df.filter(r.isNotNull()).groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), down.alias("down"))
    zero = lambda den, x: F.when(den > 1e-12, x).otherwise(0.0)
    k = math.sqrt(periods)
    return a.select(
        *keys, "n", (F.coalesce("sd", F.lit(0.0)) * k).alias("volatility"), zero(F.coalesce("sd", F.lit(0.0)), F.col("m") / F.col("sd") * k).alias("sharpe"),
        zero(F.col("down"), (F.col("m") - target) / F.col("down") * k).alias("sortino"), zero(F.col("sd") * F.col("sd"), F.col("m") / (F.col("sd") * F.col("sd"))).alias("kelly"),
    )


def drawdown(df: DataFrame, keys: list[str], order: list[str], equity: str) -> DataFrame:
    """Greatest drawdown from the running peak, and the ulcer index."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    peak = df.select(*keys, F.col(equity).alias("_e"), F.max(equity).over(w).alias("_peak"))
    dd = F.when(F.col("_peak") > 1e-12, (F.col("_peak") - F.col("_e")) / F.col("_peak")).otherwise(0.0)
    return peak.groupBy(*keys).agg(F.max(dd).alias("max_drawdown"), F.sqrt(F.avg(dd * dd * 10000)).alias("ulcer_index"))


def tail_risk(df: DataFrame, keys: list[str], ret: str, alpha: float) -> DataFrame:
    """Value at risk (the ceil(alpha * n)-th worst return, as a loss) and the mean of those returns."""
    by = W.partitionBy(*keys)
    r = df.filter(F.col(ret).isNotNull()).select(*keys, F.col(ret).alias("_r"), F.row_number().over(by.orderBy(ret)).alias("_i"), F.count(F.lit(1)).over(by).alias("_n"))
    worst = r.filter(F.col("_i") <= F.ceil(F.col("_n") * alpha))
    return worst.groupBy(*keys).agg((-F.max("_r")).alias("value_at_risk"), (-F.avg("_r")).alias("expected_shortfall"))


def trade_stats(df: DataFrame, keys: list[str], pnl: str) -> DataFrame:
    """Wins and losses (break-even in neither), profit factor (infinite without a loss) and expectancy."""
    p = F.col(pnl)
    a = df.groupBy(*keys).agg(
        F.count(p).alias("n"), F.count(F.when(p > 0, 1)).alias("wins"), F.count(F.when(p < 0, 1)).alias("losses"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("profit"), F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0)).alias("loss"),
    )
    each = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0)
    rate = lambda n: F.when(F.col("n") > 0, F.col(n) / F.col("n")).otherwise(0.0)
    factor = F.when(F.col("loss") > 0, F.col("profit") / F.col("loss")).when(F.col("profit") > 0, F.lit(float("inf"))).otherwise(0.0)
    return a.select(*keys, "n", "wins", "losses", factor.alias("profit_factor"), (rate("wins") * each("profit", "wins") - rate("losses") * each("loss", "losses")).alias("expectancy"))


def order_flow(df: DataFrame, keys: list[str], order: list[str], bid: str, bid_size: str, ask: str, ask_size: str) -> DataFrame:
    """Sum of the order-flow increments of successive quotes."""
    w = W.partitionBy(*keys).orderBy(*order)
    q = df.withColumns({f"_{c}": F.lag(c).over(w) for c in (bid, bid_size, ask, ask_size)})
    buy = F.when(F.col(bid) >= F.col(f"_{bid}"), F.col(bid_size)).otherwise(0.0) - F.when(F.col(bid) <= F.col(f"_{bid}"), F.col(f"_{bid_size}")).otherwise(0.0)
    sell = F.when(F.col(ask) <= F.col(f"_{ask}"), F.col(ask_size)).otherwise(0.0) - F.when(F.col(ask) >= F.col(f"_{ask}"), F.col(f"_{ask_size}")).otherwise(0.0)
    return q.filter(F.col(f"_{bid}").isNotNull()).groupBy(*keys).agg(F.sum(buy - sell).alias("ofi"))


def trade_imbalance(df: DataFrame, keys: list[str], size: str, bought: Column) -> DataFrame:
    all_ = F.sum(size)
    return df.groupBy(*keys).agg(F.when(all_ > 0, F.sum(F.when(bought, F.col(size)).otherwise(-F.col(size))) / all_).otherwise(0.0).alias("imbalance"))


def vpin(df: DataFrame, keys: list[str], order: list[str], buy: str, sell: str, bucket: float) -> DataFrame:
    """Mean imbalance of equal-volume buckets; a bar that crosses a boundary is split among its buckets in proportion."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    v = df.select(*keys, F.col(buy).alias("_b"), F.col(sell).alias("_s"), (F.col(buy) + F.col(sell)).alias("_v"), F.sum(F.col(buy) + F.col(sell)).over(w).alias("_end")).filter("_v > 0")
    start = F.col("_end") - F.col("_v")
    parts = v.withColumn("_k", F.explode(F.sequence(F.floor(start / bucket).cast("long"), F.greatest(F.ceil(F.col("_end") / bucket).cast("long") - 1, F.floor(start / bucket).cast("long")))))
    share = (F.least(F.col("_end"), (F.col("_k") + 1) * F.lit(bucket)) - F.greatest(start, F.col("_k") * F.lit(bucket))) / F.col("_v")
    each = parts.groupBy(*keys, "_k").agg(F.sum((F.col("_b") - F.col("_s")) * share).alias("_i"), F.sum(F.col("_v") * share).alias("_t")).filter(F.col("_t") >= bucket * (1 - 1e-9))
    return each.groupBy(*keys).agg(F.avg(F.abs(F.col("_i")) / F.lit(bucket)).alias("vpin"), F.count(F.lit(1)).alias("buckets"))


def kyle_lambda(df: DataFrame, keys: list[str], dp: str, flow: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.when(F.var_pop(flow) > 1e-12, F.covar_pop(dp, flow) / F.var_pop(flow)).otherwise(0.0).alias("kyle_lambda"))


def book_metrics(levels: DataFrame, keys: list[str], side: str, price: str, size: str) -> DataFrame:
    """Best prices, mid, micro price, spread and imbalance of order books given as level rows; null on an empty side."""
    bid, ask = F.col(side) == "bid", F.col(side) == "ask"
    b = levels.groupBy(*keys).agg(
        F.max(F.when(bid, F.struct(price, size))).alias("_b"), F.min(F.when(ask, F.struct(price, size))).alias("_a"),
        F.sum(F.when(bid, F.col(size))).alias("bid_depth"), F.sum(F.when(ask, F.col(size))).alias("ask_depth"),
    )
    bp, bs, ap, as_ = (F.col(f"{x}.{f}") for x, f in (("_b", price), ("_b", size), ("_a", price), ("_a", size)))
    mid = (bp + ap) / 2
    return b.select(
        *keys, bp.alias("best_bid"), ap.alias("best_ask"), mid.alias("mid"), ((bp * as_ + ap * bs) / (bs + as_)).alias("micro_price"), (ap - bp).alias("spread"),
        (10000.0 * (ap - bp) / mid).alias("spread_bps"), ((F.col("bid_depth") - F.col("ask_depth")) / (F.col("bid_depth") + F.col("ask_depth"))).alias("imbalance"),
    )


def fill_cost(levels: DataFrame, keys: list[str], price: str, size: str, quantity: float, buying: bool = True) -> DataFrame:
    """Average price of filling a quantity against sorted levels; partial fills are told."""
    w = W.partitionBy(*keys).orderBy(F.col(price).asc() if buying else F.col(price).desc(), size).rowsBetween(W.unboundedPreceding, 0)
    upto = levels.withColumn("_end", F.sum(size).over(w))
    take = F.greatest(F.least(F.col("_end"), F.lit(quantity)) - (F.col("_end") - F.col(size)), F.lit(0.0))
    return upto.groupBy(*keys).agg((F.sum(F.col(price) * take) / F.sum(take)).alias("vwap"), F.sum(take).alias("filled"))


def pair_regressions(prices: DataFrame, time: str, name: str, price: str) -> DataFrame:
    """Hedge ratios of all pairs of instruments at common times, from one self-join on time.

    Rows grow with the square of the instruments of one time, which is the result's own size.
    """
    a = prices.select(F.col(time).alias("t"), F.col(name).alias("a"), F.col(price).alias("x"))
    b = prices.select(F.col(time).alias("t"), F.col(name).alias("b"), F.col(price).alias("y"))
    return a.join(b, "t").filter("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.var_pop("x") > 1e-12, F.covar_pop("x", "y") / F.var_pop("x")).otherwise(0.0).alias("hedge_ratio"),
        F.when((F.var_pop("x") > 1e-12) & (F.var_pop("y") > 1e-12), F.corr("x", "y")).otherwise(0.0).alias("correlation"),
    )


def mean_reversion(df: DataFrame, keys: list[str], order: list[str], spread: str) -> DataFrame:
    """Changes regressed on the spread before: half-life -ln 2 / slope where the slope is negative."""
    w = W.partitionBy(*keys).orderBy(*order)
    lagged = df.withColumn("_l", F.lag(spread).over(w)).filter("_l is not null")
    a = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop(F.col(spread) - F.col("_l"), F.col("_l")) / F.var_pop("_l")).alias("slope"))
    return a.select(*keys, "n", "slope", F.when(F.col("slope") < 0, -math.log(2) / F.col("slope")).alias("half_life"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Covariance (n - 1) and correlation of every pair of columns, long form, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.struct(F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr")).alias(f"_{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{a}_{b}.cov").alias("covariance"), F.col(f"_{a}_{b}.corr").alias("correlation")) for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def inverse_risk_weights(df: DataFrame, name: str, ret: str, power: int = 1) -> DataFrame:
    """Weights in proportion to 1 / volatility (power 1) or 1 / variance (power 2)."""
    v = df.groupBy(name).agg(F.stddev_samp(ret).alias("sd")).filter("sd > 1e-12").withColumn("_w", 1 / F.pow(F.col("sd"), F.lit(float(power))))
    return v.join(v.agg(F.sum("_w").alias("_all")), how="cross").select(name, (F.col("_w") / F.col("_all")).alias("weight"))


def candle_patterns(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` (open, high, low, close) with the names of the one- to three-candle patterns that end at each row."""
    w = W.partitionBy(*keys).orderBy(*order)
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, c1, h1, l1 = (F.lag(x).over(w) for x in ("open", "close", "high", "low"))
    o2, c2 = F.lag("open", 2).over(w), F.lag("close", 2).over(w)
    body, span, up, down = F.abs(c - o), h - lo, h - F.greatest(o, c), F.least(o, c) - lo
    body1, body2 = F.abs(c1 - o1), F.abs(c2 - o2)
    rules = {
        "doji": (span > 0) & (body <= 0.1 * span),
        "hammer": (span > 0) & (body > 0) & (down >= 2 * body) & (up <= body),
        "inverted_hammer": (span > 0) & (body > 0) & (up >= 2 * body) & (down <= body),
        "marubozu": (span > 0) & (body >= 0.95 * span),
        "bullish_engulfing": (c1 < o1) & (c > o) & (o <= c1) & (c >= o1),
        "bearish_engulfing": (c1 > o1) & (c < o) & (o >= c1) & (c <= o1),
        "bullish_harami": (c1 < o1) & (c > o) & (o > c1) & (c < o1),
        "bearish_harami": (c1 > o1) & (c < o) & (o < c1) & (c > o1),
        "piercing_line": (c1 < o1) & (o < l1) & (c > (o1 + c1) / 2) & (c < o1),
        "dark_cloud_cover": (c1 > o1) & (o > h1) & (c < (o1 + c1) / 2) & (c > o1),
        "morning_star": (c2 < o2) & (body1 < 0.5 * body2) & (c > o) & (c > (o2 + c2) / 2),
        "evening_star": (c2 > o2) & (body1 < 0.5 * body2) & (c < o) & (c < (o2 + c2) / 2),
        "three_white_soldiers": (c2 > o2) & (c1 > o1) & (c > o) & (c1 > c2) & (c > c1),
        "three_black_crows": (c2 < o2) & (c1 < o1) & (c < o) & (c1 < c2) & (c < c1),
    }
    return df.withColumn("patterns", F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()])))


def schedule(df: DataFrame, keys: list[str], weight: Column, quantity: float) -> DataFrame:
    """``df`` with child: the part of an order for each row, by weight (negative ones clipped); equal parts where all weights vanish."""
    w = W.partitionBy(*keys)
    clipped = F.greatest(weight, F.lit(0.0))
    total = F.sum(clipped).over(w)
    return df.withColumn("child", F.when(total > 1e-12, quantity * clipped / total).otherwise(quantity / F.count(F.lit(1)).over(w)))


def hurst(df: DataFrame, keys: list[str], order: list[str], x: str, sizes: list[int]) -> DataFrame:
    """Slope of log rescaled range over log block size, whole blocks of each size only."""
    numbered = df.select(*keys, F.col(x).alias("_x"), (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).alias("_i"))
    each = numbered.withColumn("_n", F.explode(F.array(*map(F.lit, sizes)))).withColumn("_b", F.floor(F.col("_i") / F.col("_n")))
    block = W.partitionBy(*keys, "_n", "_b")
    off = each.withColumn("_d", F.col("_x") - F.avg("_x").over(block)).withColumn("_s", F.sum("_d").over(block.orderBy("_i").rowsBetween(W.unboundedPreceding, 0)))
    rs = off.groupBy(*keys, "_n", "_b").agg(F.count(F.lit(1)).alias("_c"), (F.max("_s") - F.min("_s")).alias("_r"), F.stddev_pop("_x").alias("_sd")).filter("_c = _n and _sd > 0")
    mean = rs.groupBy(*keys, "_n").agg(F.avg(F.col("_r") / F.col("_sd")).alias("_rs"))
    return mean.groupBy(*keys).agg((F.covar_pop(F.log("_rs"), F.log("_n")) / F.var_pop(F.log("_n"))).alias("hurst"))
