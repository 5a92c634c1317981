"""Linear recurrences of long series by an associative scan, and Kalman smoothing on top of it.

A step s[i] = A[i] s[i-1] + b[i] is an affine map, and maps compose. Rows are
range-partitioned by series and order and written once, so a series of any length spreads
over partitions. Each partition says how many rows its last series has there,
then which map its rows amount to; the states in which partitions begin
follow from these few numbers (one row for each partition), and one more pass over the
partitions gives every state. No task reads another's rows.

A null value is a row of its own that leaves the state as it was, unless no value came before it (then
the state is null); equal orders stand in any order, so orders should tell rows of a series apart;
a null key is a series of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograin.sources.scratch import cut


@dataclass(frozen=True)
class Linear:
    """``step(positions, values)`` gives A (n x d x d) and b (n x d) of rows; the first value of a series (position 0) has A = 0."""

    names: tuple[str, ...]
    step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def exponential_mean(alpha: float) -> Linear:
    """s = s + alpha (x - s), seeded with the first value."""

    def step(i, x):
        first = i == 0
        a = np.where(first, 0.0, 1 - alpha)
        return a[:, None, None], np.where(first, x[:, 0], alpha * x[:, 0])[:, None]

    return Linear(("ema",), step)


def double_exponential(alpha: float, beta: float) -> Linear:
    """Holt's level and trend, seeded with the first value and no trend."""
    a = np.array([[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]])
    b = np.array([alpha, alpha * beta])

    def step(i, x):
        first = i == 0
        return np.where(first[:, None, None], 0.0, a), np.where(first[:, None], np.array([1.0, 0.0]), b) * x[:, :1]

    return Linear(("level", "trend"), step)


def _advance(a: np.ndarray, b: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after each row."""
    out = np.empty_like(b)
    if b.shape[1] == 1:
        s = float(state[0])
        made = []
        for p, q in zip(a[:, 0, 0].tolist(), b[:, 0].tolist()):
            s = p * s + q if p else q
            made.append(s)
        out[:, 0] = made
        return out
    s = state
    for k in range(len(b)):
        s = a[k] @ s + b[k]
        out[k] = s
    return out


def _carried(parts: dict, join: Callable, start):
    """What each partition begins with: the state behind all partitions before it, if its first series is their last one."""
    begins, now, last = {}, start, None
    for p in sorted(parts):
        head, tail, whole, value = parts[p]
        begins[p] = now if last is not None and head == last[0] else start
        now = join(begins[p], value) if whole else join(start, value)
        last = (tail,)
    return begins


def linear_scan(df: DataFrame, keys: list[str], order: list, values: list[str], kernel: Linear, keep: list[str], partitions: int | None = None) -> DataFrame:
    """Rows (keys, kept columns, the kernel's states) of all rows of ``df``, each series in ``order`` (columns or orderings)."""
    d, spark = len(kernel.names), df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_series")
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.withColumns({f"_x{k}": F.col(v).cast("double") for k, v in enumerate(values)})
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = rows.select(*keys, *keep, series, *[f"_x{k}" for k in range(len(values))])
    rows = cut(rows.withColumn("_part", F.spark_partition_id()))
    n_x = len(values)

    def read(b):
        """Series, values and whether they count, of a batch."""
        x = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in b.columns[1 : 1 + n_x]], axis=1) if b.num_rows else np.empty((0, n_x))
        series = b.column(0)
        code = series.dictionary_encode()
        return code.indices.to_numpy(), code.dictionary, x, ~np.isnan(x).any(axis=1)

    def chunks(batches):
        """(batch, name, values, whether they count, first row, end) of stretches of one series."""
        for b in batches:
            code, names, x, good = read(b)
            ends = np.flatnonzero(np.r_[code[1:] != code[:-1], True]) + 1 if len(code) else []
            lo = 0
            for hi in ends:
                yield b, names[code[lo]].as_py(), x[lo:hi], good[lo:hi], lo, hi
                lo = hi

    def counted(batches):
        head = tail = None
        whole, n, part = True, 0, None
        for b, name, _, good, _, _ in chunks(batches):
            part = b.column(b.num_columns - 1)[0].as_py()
            if tail is not None and name != tail:
                whole, n = False, 0
            head, tail, n = name if head is None else head, name, n + int(good.sum())
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([head]), pa.array([tail]), pa.array([whole]), pa.array([n], pa.int64())], ["part", "head", "tail", "whole", "n"])

    scanned = rows.select("_series", *[f"_x{k}" for k in range(n_x)], "_part")
    counts = {r["part"]: (r["head"], r["tail"], r["whole"], r["n"]) for r in scanned.mapInArrow(counted, "part int, head string, tail string, whole boolean, n long").collect()}
    begin_at = _carried(counts, lambda at, n: at + n, 0)

    def maps(name, x, good, at):
        use = np.flatnonzero(good)
        return use, *kernel.step(at + np.arange(len(use)), x[use])

    def composed(batches):
        tail, at, part, a, b_ = None, 0, None, np.eye(d), np.zeros(d)
        for b, name, x, good, _, _ in chunks(batches):
            if part is None:
                part = b.column(b.num_columns - 1)[0].as_py()
                at = begin_at[part]
            elif name != tail:
                at, a, b_ = 0, np.eye(d), np.zeros(d)
            tail = name
            use, more_a, more_b = maps(name, x, good, at)
            at += len(use)
            for k in range(len(use)):
                a, b_ = more_a[k] @ a, more_a[k] @ b_ + more_b[k]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([[*a.ravel().tolist(), *b_.tolist()]], pa.list_(pa.float64()))], ["part", "map"])

    found = {r["part"]: np.array(r["map"]) for r in scanned.mapInArrow(composed, "part int, map array<double>").collect()}
    pieces = {p: (*counts[p][:3], found[p]) for p in counts}
    begin_in = _carried(pieces, lambda s, m: m[: d * d].reshape(d, d) @ s + m[d * d :], np.zeros(d))
    n_kept = len(keys) + len(keep)
    schema = df.select(*keys, *keep).schema
    for name in kernel.names:
        schema = schema.add(name, "double")

    def states(batches):
        tail, at, s = None, 0, np.zeros(d)
        for b in batches:
            inner = pa.RecordBatch.from_arrays(b.columns[n_kept:], b.schema.names[n_kept:])
            out = np.full((b.num_rows, d), np.nan)
            for _, name, x, good, lo, hi in chunks([inner]):
                if tail is None:
                    part = inner.column(inner.num_columns - 1)[0].as_py()
                    at, s = begin_at[part], begin_in[part]
                elif name != tail:
                    at, s = 0, np.zeros(d)
                tail = name
                use, a, b_ = maps(name, x, good, at)
                made = _advance(a, b_, s)
                # rows without a value repeat the state before them
                upto = np.cumsum(good)
                known = np.concatenate([s[None], made])
                filled = known[upto]
                if at == 0:
                    filled[upto == 0] = np.nan
                out[lo:hi] = filled
                at, s = at + len(use), known[-1]
            cols = [pa.array(out[:, k], pa.float64(), from_pandas=True) for k in range(d)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], *cols], schema.names)

    return rows.mapInArrow(states, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


#: Steps after which a filter's gains have settled for any sensible ratio of variances.
MOST_GAINS = 100_000


def trend_gains(level: float, slope: float, measurement: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward maps, forward gains, smoothing gains by position until they settle; they don't depend on the data."""
    f = np.array([[1.0, 1.0], [0.0, 1.0]])
    q = np.diag([level, slope])
    predicted = np.diag([measurement + level, measurement + slope])
    ahead, gains, back = [], [], []
    while len(gains) < MOST_GAINS:
        k = predicted[:, 0] / (predicted[0, 0] + measurement)
        held = predicted - np.outer(k, predicted[0])
        held = (held + held.T) / 2
        following = f @ held @ f.T + q
        ahead.append(f - np.outer(k, f[0]))
        gains.append(k)
        back.append(held @ f.T @ np.linalg.inv(following))
        if np.abs(following - predicted).max() <= 1e-15 * np.abs(predicted).max():
            break
        predicted = following
    return np.array(ahead), np.array(gains), np.array(back), f


def smoothed_trend(df: DataFrame, keys: list[str], order: list[str], value: str, level: float, slope: float, measurement: float, keep: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Rows (keys, order, kept, smoothed, slope): a local linear trend, filtered forwards and smoothed backwards.

    The filter starts at the first value without a slope. Series of fewer than three values come back as they are, with slope 0.
    ``order`` has to tell the rows of a series apart.
    """
    ahead, gains, back, f = trend_gains(level, slope, measurement)
    settled = len(gains) - 1
    keep = [c for c in keep or [] if c not in order]

    def forward(i, x):
        at = np.minimum(i, settled)
        first = (i == 0)[:, None]
        b = gains[at] * x[:, :1]
        start = np.stack([x[:, 0], np.zeros(len(x))], axis=1)
        return np.where(first[:, :, None], 0.0, ahead[at]), np.where(first, start, b)

    whole = df.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(1.0))
    count = Linear(("_position",), lambda i, x: (np.zeros((len(i), 1, 1)), i[:, None].astype(float)))
    both = Linear(("_level", "_slope", "_position"), lambda i, x: _beside(forward(i, x), count.step(i, x)))
    filtered = linear_scan(whole, keys, order, [value], both, [*order, *keep, value], partitions)

    def backward(j, x):
        at = np.minimum(x[:, 2].astype(np.int64), settled)
        g = back[at]
        own = x[:, :2]
        last = (j == 0)[:, None]
        rest = own - np.einsum("nij,nj->ni", g @ f, own)
        # (whether the series has three values is known at its last one)
        a, b = np.where(last[:, :, None], 0.0, g), np.where(last, own, rest)
        n, held = len(j), np.where(j == 0, 0.0, 1.0)
        wide_a, wide_b = np.zeros((n, 3, 3)), np.zeros((n, 3))
        wide_a[:, :2, :2], wide_b[:, :2] = a, b
        wide_a[:, 2, 2], wide_b[:, 2] = held, np.where(j == 0, x[:, 2] + 1, 0.0)
        return wide_a, wide_b

    reverse = [F.col(o).desc() for o in order]
    names = ("_smooth", "_trend", "_n")
    out = linear_scan(filtered, keys, reverse, ["_level", "_slope", "_position"], Linear(names, backward), [*order, *keep, value], partitions)
    short = F.col("_n") < 3
    return out.select(*keys, *order, *keep, F.when(short, F.col(value).cast("double")).otherwise(F.col("_smooth")).alias("smoothed"), F.when(short, F.lit(0.0)).otherwise(F.col("_trend")).alias("slope"))


def _beside(one, other):
    """Two recurrences side by side as one."""
    (a, b), (c, e) = one, other
    n, d, k = len(b), b.shape[1], e.shape[1]
    wide = np.zeros((n, d + k, d + k))
    wide[:, :d, :d], wide[:, d:, d:] = a, c
    return wide, np.concatenate([b, e], axis=1)
