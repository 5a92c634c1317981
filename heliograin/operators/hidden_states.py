"""Hidden Markov models over many sequences of symbols.

A sequence is one row (its length is bounded by what a task holds: some 8 bytes a symbol and state). Each round of training
is one pass: tasks run forwards and backwards over blocks of sequences and
give their expected counts, which one aggregate adds up; only states x symbols numbers reach the driver. Probabilities are
kept above 1e-100. Null symbols are left out; rows with a null key belong to no sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograin.sources.scratch import cut

#: The least a probability is taken for.
LEAST = 1e-100
#: Most numbers of a model, which the driver and every task hold.
MOST_NUMBERS = 4_000_000
#: Symbols whose tables a task holds at once.
BLOCK_SYMBOLS = 200_000


@dataclass(frozen=True)
class Model:
    symbols: tuple
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(symbols: list, states: int, seed: int = 0) -> Model:
        """Seeded differences between states, which stay as they are more often than not: from near uniform moves, training hardly leaves its first plateau."""
        if states * (states + len(symbols)) > MOST_NUMBERS:
            raise ValueError(f"a model of {states} states and {len(symbols)} symbols has more than {MOST_NUMBERS} numbers")
        rng = np.random.default_rng(seed)
        made = [rng.uniform(0.5, 1.5, shape) for shape in ((1, states), (states, states), (states, len(symbols)))]
        made[1] += np.eye(states) * states
        start, move, emit = [p / np.maximum(p.sum(axis=1, keepdims=True), LEAST) for p in made]
        return Model(tuple(symbols), start[0], move, emit)


def sequences(df: DataFrame, key: str, order: list[str], symbol: str, keep: str | None = None) -> DataFrame:
    """Rows (key, symbols, kept): each sequence in order, and the kept column of its rows."""
    rows = df.filter(F.col(key).isNotNull() & F.col(symbol).isNotNull())
    held = F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(keep or order[-1]).alias("_k"), F.col(symbol).alias("_s"))))
    return rows.groupBy(F.col(key).alias("key")).agg(held.alias("_h")).select("key", F.col("_h._s").alias("symbols"), F.col("_h._k").alias("kept"))


def alphabet(seqs: DataFrame) -> list:
    """The distinct symbols in order; more than a model can have are an error."""
    found = [r[0] for r in seqs.select(F.explode("symbols").alias("s")).distinct().orderBy("s").limit(MOST_NUMBERS + 1).collect()]
    if len(found) > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS} distinct symbols")
    return found


def expected(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log-likelihood, of coded sequences side by side."""
    seqs = sorted((s for s in seqs if len(s)), key=len, reverse=True)
    start, move, emit = (np.maximum(p, LEAST) for p in (model.start, model.move, model.emit))
    n, likely = len(start), 0.0
    starts, moves, emits = np.zeros(n), np.zeros((n, n)), np.zeros(emit.shape)
    if not seqs:
        return starts, moves, emits, likely
    sizes = np.array([len(s) for s in seqs])
    flat, offset = np.concatenate(seqs), np.r_[0, np.cumsum(sizes)[:-1]]
    alphas, scales = [], []
    for t in range(sizes[0]):
        live = int(np.searchsorted(-sizes, -t))  # sequences longer than t
        seen = emit[:, flat[offset[:live] + t]].T
        a = (start if t == 0 else alphas[-1][:live] @ move) * seen
        c = a.sum(axis=1)
        alphas.append(a / c[:, None])
        scales.append(c)
        likely += float(np.log(c).sum())
    beta = np.ones((0, n))
    for t in range(sizes[0] - 1, -1, -1):
        live = len(alphas[t])
        now = np.ones((live, n))
        if len(beta):
            ahead = beta * emit[:, flat[offset[: len(beta)] + t + 1]].T / scales[t + 1][:, None]
            now[: len(beta)] = ahead @ move.T
            moves += move * (alphas[t][: len(beta)].T @ ahead)
        gamma = alphas[t] * now
        np.add.at(emits.T, flat[offset[:live] + t], gamma)
        if t == 0:
            starts += gamma.sum(axis=0)
        beta = now
    return starts, moves, emits, likely


def _coded(model: Model, batches):
    places = {s: i for i, s in enumerate(model.symbols)}
    for b in batches:
        yield b, [np.array([places[s] for s in x], np.int64) for x in b.column(b.schema.get_field_index("symbols")).to_pylist()]


def one_round(seqs: DataFrame, model: Model) -> tuple[Model, float]:
    """A model that no likelihood falls under, and the log-likelihood under the old one."""

    def counted(batches):
        total, n = None, len(model.start)
        for _, held in _coded(model, batches):
            block, size = [], 0
            for k, s in enumerate(held):
                block.append(s)
                size += len(s)
                if size >= BLOCK_SYMBOLS or k == len(held) - 1:
                    *parts, likely = expected(model, block)
                    more = np.concatenate([p.ravel() for p in parts] + [[likely]])
                    total, block, size = more if total is None else total + more, [], 0
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "v"])

    sums = seqs.select("symbols").mapInArrow(counted, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    n, m = model.emit.shape
    got = np.zeros(n + n * n + n * m + 1)
    for r in sums:
        got[r["place"]] = r["v"]
    start, move, emit = got[:n][None], got[n : n + n * n].reshape(n, n), got[n + n * n : -1].reshape(n, m)
    share = lambda new, old: np.where(new.sum(axis=1, keepdims=True) > 0, new / np.maximum(new.sum(axis=1, keepdims=True), LEAST), old)
    return Model(model.symbols, share(start, model.start[None])[0], share(move, model.move), share(emit, model.emit)), float(got[-1])


def train(seqs: DataFrame, model: Model, most_rounds: int, tolerance: float = 0.0) -> tuple[Model, list[float]]:
    """The model after at most ``most_rounds`` rounds, and the log-likelihood before each; stops when it gains no more than ``tolerance``."""
    seqs, history = cut(seqs), []
    for _ in range(most_rounds):
        model, likely = one_round(seqs, model)
        history.append(likely)
        if len(history) > 1 and history[-1] - history[-2] <= tolerance:
            break
    return model, history


def best_path(model: Model, s: np.ndarray) -> np.ndarray:
    """The likeliest states of one coded sequence; ties go to the smaller state."""
    start, move, emit = (np.log(np.maximum(p, LEAST)) for p in (model.start, model.move, model.emit))
    if not len(s):
        return np.empty(0, np.int64)
    score, came = start + emit[:, s[0]], []
    for x in s[1:]:
        ways = score[:, None] + move
        came.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + emit[:, x]
    out = [int(score.argmax())]
    for back in reversed(came):
        out.append(int(back[out[-1]]))
    return np.array(out[::-1])


def decode(seqs: DataFrame, model: Model) -> DataFrame:
    """Rows (key, kept, state) of all elements of all sequences."""
    fields = {f.name: f.dataType.simpleString() for f in seqs.schema.fields}

    def paths(batches):
        for b, held in _coded(model, batches):
            states = pa.array([best_path(model, s).tolist() for s in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), states], ["key", "kept", "states"])

    found = seqs.select("key", "symbols", "kept").mapInArrow(paths, f"key {fields['key']}, kept {fields['kept']}, states array<bigint>")
    return found.select("key", F.explode(F.arrays_zip("kept", "states")).alias("e")).select("key", F.col("e.kept").alias("kept"), F.col("e.states").alias("state"))
