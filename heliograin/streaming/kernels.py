"""Order-dependent recurrences as state kernels, shared by batch and streaming.

A kernel has an initial state and a step: (state, value) -> (state, outputs).
``in_batch`` runs it over sorted partitions, carrying one series' state at a
time; ``in_stream`` keeps the state in Structured Streaming's state store. A
series is read in order by one task; many series run side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kernel:
    names: tuple[str, ...]
    start: tuple
    step: Callable


def ema(alpha: float) -> Kernel:
    """Exponential mean seeded with the first value."""

    def step(s, x):
        v = x if s[0] is None else s[0] + alpha * (x - s[0])
        return (v,), (v,)

    return Kernel(("ema",), (None,), step)


def seeded_ema(n: int) -> Kernel:
    """Exponential mean with alpha 2 / (n + 1), seeded with the mean of the first n values; null before."""
    a = 2.0 / (n + 1)

    def step(s, x):
        count, total, v = s
        if count < n:
            count, total = count + 1, total + x
            v = total / n if count == n else None
        else:
            v = v + a * (x - v)
        return (count, total, v), (v,)

    return Kernel(("ema",), (0, 0.0, None), step)


def wilder(n: int) -> Kernel:
    """Wilder's mean: seeded with the mean of the first n values, then (v * (n - 1) + x) / n."""

    def step(s, x):
        count, total, v = s
        if count < n:
            count, total = count + 1, total + x
            v = total / n if count == n else None
        else:
            v = (v * (n - 1) + x) / n
        return (count, total, v), (v,)

    return Kernel(("wilder",), (0, 0.0, None), step)


def rsi(n: int) -> Kernel:
    """Relative strength index over Wilder means of gains and losses; 100 without losses."""

    def step(s, x):
        last, count, up, down = s
        if last is None:
            return (x, 0, 0.0, 0.0), (None,)
        gain, loss = max(x - last, 0.0), max(last - x, 0.0)
        count += 1
        if count <= n:
            up, down = up + gain / n, down + loss / n
        else:
            up, down = (up * (n - 1) + gain) / n, (down * (n - 1) + loss) / n
        out = None if count < n else 100.0 if down <= 1e-12 else 100.0 - 100.0 / (1.0 + up / down)
        return (x, count, up, down), (out,)

    return Kernel(("rsi",), (None, 0, 0.0, 0.0), step)


def holt(alpha: float, beta: float) -> Kernel:
    """Double exponential smoothing: level and trend; the fitted value is the forecast made a step before."""

    def step(s, x):
        level, trend, n = s
        if n == 0:
            return (x, 0.0, 1), (x, 0.0, None)
        if n == 1:
            trend = x - level
            return (x, trend, 2), (x, trend, None)
        fit = level + trend
        new = alpha * x + (1 - alpha) * fit
        trend = beta * (new - level) + (1 - beta) * trend
        return (new, trend, n + 1), (new, trend, fit)

    return Kernel(("level", "trend", "fitted"), (None, 0.0, 0), step)


def holt_winters(alpha: float, beta: float, gamma: float, season: int) -> Kernel:
    """Additive triple smoothing, started from the first whole season."""

    def step(s, x):
        level, trend, first, seasonal, k = s
        if k < season:
            first = (*first, x)
            if k + 1 < season:
                return (level, trend, first, seasonal, k + 1), (None, None)
            level = sum(first) / season
            return (level, 0.0, (), tuple(v - level for v in first), k + 1), (level, None)
        at = k % season
        fit = level + trend + seasonal[at]
        new = alpha * (x - seasonal[at]) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        seasonal = (*seasonal[:at], gamma * (x - new) + (1 - gamma) * seasonal[at], *seasonal[at + 1 :])
        return (new, trend, (), seasonal, k + 1), (new, fit)

    return Kernel(("level", "fitted"), (None, 0.0, (), (), 0), step)


def cusum(target: float, slack: float, threshold: float) -> Kernel:
    """Two-sided CUSUM; a side that signals goes back to 0."""

    def step(s, x):
        up, down = max(0.0, s[0] + x - target - slack), max(0.0, s[1] + target - x - slack)
        signal = 1.0 if up > threshold else -1.0 if down > threshold else 0.0
        return (0.0 if signal > 0 else up, 0.0 if signal < 0 else down), (up, down, signal)

    return Kernel(("high", "low", "signal"), (0.0, 0.0), step)


def page_hinkley(delta: float, threshold: float, least: int) -> Kernel:
    """Cumulative deviation from the running mean over its minimum; starts anew after a signal."""

    def step(s, x):
        n, mean, total, low = s
        n += 1
        mean += (x - mean) / n
        total += x - mean - delta
        low = min(low, total)
        hit = n >= least and total - low > threshold
        return ((0, 0.0, 0.0, 0.0) if hit else (n, mean, total, low)), (total - low, float(hit))

    return Kernel(("deviation", "signal"), (0, 0.0, 0.0, 0.0), step)


def ewma_chart(target: float, sigma: float, lam: float, width: float) -> Kernel:
    """EWMA chart with limits that widen with the number of values."""

    def step(s, x):
        v, n = s
        v, n = lam * x + (1 - lam) * v, n + 1
        limit = width * sigma * (lam / (2 - lam) * (1 - (1 - lam) ** (2 * n))) ** 0.5
        return (v, n), (v, limit, float(abs(v - target) > limit))

    return Kernel(("ewma", "limit", "signal"), (target, 0), step)


def health_index(lo: float, hi: float, alpha: float) -> Kernel:
    """A value scaled and clamped to 0..1 and smoothed."""

    def step(s, x):
        v = min(max((x - lo) / (hi - lo), 0.0), 1.0)
        v = v if s[0] is None else alpha * v + (1 - alpha) * s[0]
        return (v,), (v,)

    return Kernel(("health",), (None,), step)


def kalman(process: float, measurement: float) -> Kernel:
    """One-dimensional Kalman smoother of a level, started at the first value."""

    def step(s, x):
        if s[0] is None:
            return (x, measurement), (x,)
        p = s[1] + process
        gain = p / (p + measurement)
        v = s[0] + gain * (x - s[0])
        return (v, (1 - gain) * p), (v,)

    return Kernel(("level",), (None, 0.0), step)


def adaptive_alpha(target: float, rate: float) -> Kernel:
    """Adaptive conformal level: moves down after a miss (value 1) and up after a hit (0)."""

    def step(s, x):
        a = s[0] + rate * (target - x)
        return (a,), (min(max(a, 0.0), 1.0),)

    return Kernel(("alpha",), (target,), step)


def spikes(window: int, alpha: float, factor: float) -> Kernel:
    """Maxima of tumbling count windows against their running exponential mean."""

    def step(s, x):
        top, n, mean = s
        top, n = max(top, x), n + 1
        if n < window:
            return (top, n, mean), (None, 0.0)
        hit = mean is not None and top > factor * mean
        return (float("-inf"), 0, top if mean is None else mean + alpha * (top - mean)), (top, float(hit))

    return Kernel(("window_max", "spike"), (float("-inf"), 0, None), step)


def macd(fast: int, slow: int, signal: int) -> Kernel:
    """Difference of two seeded exponential means, and the seeded mean of that difference."""
    a, b, c = seeded_ema(fast), seeded_ema(slow), seeded_ema(signal)

    def step(s, x):
        sa, (va,) = a.step(s[0], x)
        sb, (vb,) = b.step(s[1], x)
        line = None if va is None or vb is None else va - vb
        sc, (vc,) = (s[2], (None,)) if line is None else c.step(s[2], line)
        return (sa, sb, sc), (line, vc)

    return Kernel(("macd", "signal"), (a.start, b.start, c.start), step)


def _true_range(last, high, low, close):
    return high - low if last is None else max(high - low, abs(high - last), abs(low - last))


def keltner(n: int, width: float) -> Kernel:
    """(high, low, close): seeded exponential mean of closes with a band of Wilder's mean true range."""
    mid, atr = seeded_ema(n), wilder(n)

    def step(s, x):
        sm, (m,) = mid.step(s[0], x[2])
        sr, (r,) = atr.step(s[1], _true_range(s[2], *x))
        full = m is not None and r is not None
        return (sm, sr, x[2]), ((m - width * r, m, m + width * r) if full else (None, None, None))

    return Kernel(("lower", "middle", "upper"), (mid.start, atr.start, None), step)


def supertrend(n: int, width: float) -> Kernel:
    """(high, low, close): a trailing band that changes side when the close crosses it."""
    atr = wilder(n)

    def step(s, x):
        state, last, upper, lower, up = s
        high, low, close = x
        state, (r,) = atr.step(state, _true_range(last, *x))
        if r is None:
            return (state, close, None, None, True), (None, None)
        mid = (high + low) / 2
        top, bottom = mid + width * r, mid - width * r
        if upper is not None:
            top = top if top < upper or last > upper else upper
            bottom = bottom if bottom > lower or last < lower else lower
            up = close >= bottom if up else close > top
        return (state, close, top, bottom, up), (bottom if up else top, 1.0 if up else -1.0)

    return Kernel(("band", "direction"), (atr.start, None, None, None, True), step)


def directional(n: int) -> Kernel:
    """(high, low, close): +DI, -DI and ADX over Wilder's means."""
    means = [wilder(n) for _ in range(4)]

    def step(s, x):
        last, states = s
        if last is None:
            return (x, states), (None, None, None)
        up, down = x[0] - last[0], last[1] - x[1]
        raw = (up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0, _true_range(last[2], *x))
        new, out = zip(*(k.step(st, v) for k, st, v in zip(means, states, raw)))
        p, m, r = (v[0] for v in out)
        if r is None:
            return (x, (*new, states[3])), (None, None, None)
        plus, minus = (100 * p / r, 100 * m / r) if r > 1e-12 else (0.0, 0.0)
        dx = 100 * abs(plus - minus) / (plus + minus) if plus + minus > 1e-12 else 0.0
        sx, (adx,) = means[3].step(states[3], dx)
        return (x, (*new, sx)), (plus, minus, adx)

    return Kernel(("plus_di", "minus_di", "adx"), (None, tuple(k.start for k in means)), step)


def sequence_monitor() -> Kernel:
    """(state number, sequence number): 0 first seen, 1 valid, 2 replay, 3 spoof; only valid messages move the known state."""

    def step(s, x):
        if s is None:
            return x, (0.0,)
        if (x[0] == s[0] + 1 and x[1] == 0) or (x[0] == s[0] and x[1] == s[1] + 1):
            return x, (1.0,)
        return s, (2.0 if x <= s else 3.0,)

    return Kernel(("verdict",), None, step)


def rollback_monitor(window: int, floor: float, least: int) -> Kernel:
    """Hits (1 or 0) in a sliding window: coverage, and a rollback that stays once coverage falls below the floor."""

    def step(s, x):
        held, latched = (*s[0], x)[-window:], s[1]
        cover = sum(held) / len(held)
        latched = latched or (len(held) >= least and cover < floor)
        return (held, latched), (cover, float(latched))

    return Kernel(("coverage", "rollback"), ((), False), step)


def run_to_run(target: float, slope: float, lam: float) -> Kernel:
    """Outputs of runs: EWMA of the process offset, and the next recipe that would hit the target."""

    def step(s, x):
        offset, recipe = s
        offset = lam * (x - slope * recipe) + (1 - lam) * offset
        recipe = (target - offset) / slope
        return (offset, recipe), (offset, recipe)

    return Kernel(("offset", "recipe"), (0.0, target / slope), step)


def rainflow(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows (key, range, mean, count): rainflow cycles of each series' turning points; what is left over counts half."""

    def pairs(stack, last):
        while len(stack) >= 3 and abs(stack[-1] - stack[-2]) >= abs(stack[-2] - stack[-3]):
            a, b = stack[-3], stack[-2]
            half = len(stack) == 3
            stack[:] = stack[1:] if half else [*stack[:-3], stack[-1]]
            yield abs(a - b), (a + b) / 2, 0.5 if half else 1.0
        if last:
            for a, b in zip(stack, stack[1:]):
                yield abs(a - b), (a + b) / 2, 0.5

    def run(batches):
        now, stack = object(), []
        for b in batches:
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    out += ended(now, stack)
                    now, stack = k, []
                if len(stack) >= 2 and (stack[-1] - stack[-2]) * (x - stack[-1]) >= 0:
                    stack[-1] = x  # no turning point yet
                elif not stack or x != stack[-1]:
                    # what was last is a turning point now, so cycles may close on it
                    out += [(now, *c) for c in pairs(stack, False)]
                    stack.append(x)
            yield made(out)
        yield made(ended(now, stack))

    def ended(now, stack):
        return [(now, *c) for c in pairs(stack, True)]

    kind = df.schema[key].dataType

    def made(out):
        cols = list(zip(*out)) if out else [()] * 4
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)), *[pa.array(c, pa.float64()) for c in cols[1:]]], [key, "range", "mean", "count"])

    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_x"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    held = rows.repartition(F.col(key)).sortWithinPartitions(key, *[f"_o{i}" for i in range(len(order))])
    return held.select(key, "_x").mapInArrow(run, f"`{key}` {kind.simpleString()}, range double, mean double, count double")


def _ordered(df: DataFrame, key: str, order: list[str], values: list[str], keep: list[str], start: DataFrame | None) -> DataFrame:
    """Rows (key, kept, saved state, values), a series' rows together and in order; a saved state stands on a row of its own before them."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.dropna(subset=values).select(F.col(key), *keep, F.lit(None).cast("string").alias("_state"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(values)])
    rows = rows.withColumn("_saved", F.lit(1))
    if start is not None:
        saved = start.select(F.col(key).cast(kind).alias(key), F.col("state").alias("_state"), F.lit(0).alias("_saved"))
        rows = rows.unionByName(saved, allowMissingColumns=True)
    held = rows.repartition(F.col(key)).sortWithinPartitions(key, "_saved", *[f"_o{i}" for i in range(len(order))])
    return held.select(key, *keep, "_state", *[f"_x{i}" for i in range(len(values))])


def to_text(state: tuple) -> str:
    """A state as JSON, which a table can hold and any later version can read."""
    return json.dumps(state)


def from_text(text: str) -> tuple:
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return tuples(json.loads(text))


def in_batch(df: DataFrame, key: str, order: list[str], value: str | list[str], kernel: Kernel, keep: list[str] | None = None, start: DataFrame | None = None) -> DataFrame:
    """Rows (key, kept columns, outputs): the kernel over each key's rows in order; rows with a null value are left out.

    A list of values reaches the kernel as a tuple. ``start`` is a table (key, state) of saved
    states, one for each key at most, from which the keys in it go on.
    """
    keep = order if keep is None else keep
    several, values = not isinstance(value, str), [value] if isinstance(value, str) else list(value)
    schema = df.select(key, *keep).schema
    for name in kernel.names:
        schema = schema.add(name, "double")
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches):
        now, state = object(), kernel.start
        for b in batches:
            out: list[tuple] = []
            saved = b.column(b.num_columns - len(values) - 1)
            inputs = [c.to_pylist() for c in b.columns[-len(values) :]]
            for k, old, x in zip(b.column(0).to_pylist(), saved.to_pylist(), zip(*inputs) if several else inputs[0]):
                if k != now:
                    now, state = k, kernel.start
                if old is not None:
                    state = from_text(old)
                    continue
                state, made = kernel.step(state, x)
                out.append(made)
            cols = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * len(kernel.names)
            rest = b.select(b.schema.names[: -len(values) - 1]).filter(saved.is_null())
            yield pa.RecordBatch.from_arrays([*rest.columns, *cols], [*rest.schema.names, *kernel.names])

    return _ordered(df, key, order, values, keep, start).mapInArrow(run, plain)


def states_after(df: DataFrame, key: str, order: list[str], value: str | list[str], kernel: Kernel, start: DataFrame | None = None) -> DataFrame:
    """Rows (key, state): each key's state behind its last row, as JSON; keys that only ``start`` has keep theirs."""
    several, values = not isinstance(value, str), [value] if isinstance(value, str) else list(value)
    kind = df.schema[key].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        now, state, ended = None, None, []
        some = False

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ended], to_arrow_type(kind)), pa.array([s for _, s in ended], pa.string())], [key, "state"])

        for b in batches:
            inputs = [c.to_pylist() for c in b.columns[2:]]
            for k, old, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), zip(*inputs) if several else inputs[0]):
                if not some or k != now:
                    if some:
                        ended.append((now, to_text(state)))
                    now, state, some = k, kernel.start, True
                state = kernel.step(state, x)[0] if old is None else from_text(old)
            yield packed()
            ended = []
        if some:
            ended.append((now, to_text(state)))
            yield packed()

    return _ordered(df, key, order, values, [], start).mapInArrow(run, f"`{key}` {kind.simpleString()}, state string")


def in_stream(df: DataFrame, key: str, order: str, value: str, kernel: Kernel, start: DataFrame | None = None) -> DataFrame:
    """The same kernel over a stream: rows (key, order, outputs); a micro-batch's rows of a key are taken in order of ``order``.

    The state store's checkpoint resumes a stopped query. A new query takes over from a batch
    table ``start`` (key, state): a key's first rows bring its saved state along by a stream-static join.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = df.select(key, order).schema
    for name in kernel.names:
        schema = schema.add(name, "double")

    def run(_key, frames, state):
        rows = pd.concat(list(frames))
        rows = rows[rows[value].notna()].sort_values(order, kind="stable")
        saved = rows["_state"].iloc[0] if len(rows) else None
        held = from_text(state.get[0]) if state.exists else from_text(saved) if isinstance(saved, str) else kernel.start
        out = []
        for x in rows[value].astype(float):
            held, made = kernel.step(held, x)
            out.append(made)
        if len(rows):
            state.update((to_text(held),))
        made = pd.DataFrame(out, columns=list(kernel.names), dtype=float)
        yield pd.concat([rows[[key, order]].reset_index(drop=True), made], axis=1)

    rows = df.select(key, order, value)
    if start is None:
        rows = rows.withColumn("_state", F.lit(None).cast("string"))
    else:
        rows = rows.join(start.select(F.col(key).alias("_of"), F.col("state").alias("_state")), F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")
    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def saved_states(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Rows (key, state) of a stopped ``in_stream`` query, read from its checkpoint; a table for ``start``."""
    return spark.read.format("statestore").load(checkpoint).select(F.col(f"key.{key}").alias(key), F.col("value.groupState.state").alias("state"))
