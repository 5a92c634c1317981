"""Topic models over bags of words, by expectation maximisation.

A document mixes topics, a topic is a distribution of terms; both are the likeliest ones under symmetric
Dirichlet priors, given as pseudo-counts (0: none). A bag is one row and holds no more terms than the vocabulary.
Each round is one pass: tasks find the mixes of blocks of bags under the topics
so far, a concave problem, and give expected counts of topics and terms, which one aggregate adds up. Only topics x terms
numbers reach the driver. Documents without a term of the vocabulary have no bag.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograin.sources.scratch import new_path

#: Most numbers of a model, which the driver and every task hold.
MOST_NUMBERS = 4_000_000
#: Terms of bags that a task works on at once (times the topics, doubles), and those whose mixes are found side by side.
BLOCK_TERMS, SLAB_TERMS = 200_000, 50_000
#: Bags side by side are padded to the size of the longest: at most so many times the shortest, and so many terms more.
ALIKE, ALIKE_TERMS = 1.25, 4
#: A mix is settled when no share moves more; rounds inside a bag at most.
SETTLED, MOST_STEPS = 1e-5, 200
#: The least a probability is taken for.
LEAST = 1e-100


@dataclass(frozen=True)
class Topics:
    terms: tuple
    weights: np.ndarray
    mix_prior: float = 0.0
    term_prior: float = 0.0

    @staticmethod
    def first(terms: list, topics: int, mix_prior: float = 0.1, term_prior: float = 0.01, seed: int = 0) -> Topics:
        """Seeded topics that differ, from which training starts."""
        if topics < 1 or topics * len(terms) > MOST_NUMBERS:
            raise ValueError(f"{topics} topics of {len(terms)} terms: a model has 1 to {MOST_NUMBERS} numbers")
        drawn = np.random.default_rng(seed).gamma(1.0, size=(topics, len(terms))) + 0.1
        return Topics(tuple(terms), drawn / np.maximum(drawn.sum(axis=1, keepdims=True), LEAST), mix_prior, term_prior)


def vocabulary(counts: DataFrame, size: int) -> list:
    """The ``size`` terms of most documents, equal ones by term; counts has rows (id, term, n)."""
    if size > MOST_NUMBERS:
        raise ValueError(f"a vocabulary has at most {MOST_NUMBERS} terms")
    found = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "term").limit(size)
    return [r["term"] for r in found.collect()]


def gathered(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """Rows (id, terms, ns): how often each document with words has each; ids are integers or strings, rows of one id are one document.

    Documents come to the tasks by id and in its order, so that a task counts a batch of them at once and holds one document
    besides. Written once, so that vocabulary and bags don't make the words again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.repartition(F.col(id_col)).sortWithinPartitions(id_col).select(F.col(id_col).alias("id"), words.alias("words"))
    path = new_path(docs.sparkSession, "terms")
    rows.mapInArrow(_counted, f"id {kind}, terms array<string>, ns array<long>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _counted(batches):
    """Batches (id, terms, ns) of sorted rows (id, words); the last document of a batch may go on in the next."""
    held = None
    for b in batches:
        ids, words = (b.column(b.schema.get_field_index(n)) for n in ("id", "words"))
        if not len(ids):
            continue
        told, before, after = ids.is_valid(), ids.slice(0, len(ids) - 1), ids.slice(1)
        other = np.asarray(pc.fill_null(pc.not_equal(before, after), False)) | (np.asarray(told)[1:] != np.asarray(told)[:-1])
        firsts = np.r_[0, np.flatnonzero(other) + 1]
        of = np.repeat(np.cumsum(np.r_[0, other]), np.asarray(pc.fill_null(words.value_lengths(), 0)))
        coded = words.flatten().dictionary_encode()
        keys, n = np.unique(of * max(len(coded.dictionary), 1) + np.asarray(coded.indices), return_counts=True)
        of, codes = np.divmod(keys, max(len(coded.dictionary), 1))
        ends = np.r_[0, np.cumsum(np.bincount(of.astype(int), minlength=len(firsts)))]
        made = _bags(ids.take(pa.array(firsts)), ends, coded.dictionary.take(pa.array(codes)), n)
        if held is not None and held.column("id").equals(made.column("id").slice(0, 1)):
            held, made = _one(held, made.slice(0, 1)), made.slice(1)
        if len(made):
            if held is not None:
                yield _with_words(held)
            yield _with_words(made.slice(0, len(made) - 1))
            held = made.slice(len(made) - 1)
    if held is not None:
        yield _with_words(held)


def _bags(ids, ends, terms, ns) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (terms.cast(pa.string()), pa.array(ns, pa.int64()))]
    return pa.RecordBatch.from_arrays([ids, *lists], ["id", "terms", "ns"])


def _one(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """The words of two rows of a document as one row."""
    coded = pa.concat_arrays([a.column("terms").flatten(), b.column("terms").flatten()]).dictionary_encode()
    n = np.zeros(len(coded.dictionary), int)
    np.add.at(n, np.asarray(coded.indices), np.r_[np.asarray(a.column("ns").flatten()), np.asarray(b.column("ns").flatten())])
    return _bags(a.column("id"), [0, len(n)], coded.dictionary, n)


def _with_words(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.filter(pc.greater(b.column("terms").value_lengths(), 0))


def _by_id(counts: DataFrame) -> DataFrame:
    held = counts.groupBy("id").agg(F.collect_list(F.struct("term", F.col("n").cast("long").alias("n"))).alias("_b"))
    return held.select("id", F.col("_b.term").alias("terms"), F.col("_b.n").alias("ns"))


def bags(counts: DataFrame, terms: list) -> DataFrame:
    """Rows (id, places, counts) of the terms' places in the vocabulary, in order; counts has rows (id, term, n), or is what ``gathered`` gives."""

    def placed(batches):
        known = pa.array(terms, pa.string())
        for b in batches:
            ids, words, ns = (b.column(b.schema.get_field_index(n)) for n in ("id", "terms", "ns"))
            places = pc.index_in(words.flatten().cast(pa.string()), value_set=known)
            in_vocabulary = np.asarray(places.is_valid())
            rows = np.repeat(np.arange(len(ids)), np.asarray(words.value_lengths()))[in_vocabulary]
            places, n = np.asarray(places.drop_null()), np.asarray(ns.flatten())[in_vocabulary]
            order = np.lexsort((places, rows))
            sizes = np.bincount(rows, minlength=len(ids))
            ends = pa.array(np.r_[0, np.cumsum(sizes[sizes > 0])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (places.astype(np.int32), n)]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(sizes > 0)), *lists], ["id", "places", "counts"])

    rows = counts if "terms" in counts.columns else _by_id(counts)
    kind = rows.schema["id"].dataType.simpleString()
    # a stated number of parts: bags are small and much is computed on each
    return rows.mapInArrow(placed, f"id {kind}, places array<int>, counts array<long>").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def _alike(sizes: np.ndarray):
    """Runs of the places of bags of like sizes, no more terms in a run than a slab holds or one bag has."""
    order = np.argsort(sizes, kind="stable")
    ranked, at = sizes[order], 0
    while at < len(order):
        to = int(np.searchsorted(ranked, ranked[at] * ALIKE + ALIKE_TERMS, side="right"))
        to = min(to, at + max(1, int(SLAB_TERMS // ranked[to - 1])))
        yield order[at:to]
        at = to


def settle(model: Topics, starts: np.ndarray, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest mixes of bags, those of like sizes side by side, and each entry's probability under them."""
    k, sizes = len(model.weights), np.diff(np.r_[starts, len(places)])
    given = np.maximum(model.weights.T[places], LEAST)
    mixes = np.full((len(starts), k), 1.0 / k)
    for live in _alike(sizes):
        at = np.arange(sizes[live].max())
        real = at < sizes[live][:, None]
        entry = starts[live][:, None] + np.where(real, at, 0)
        n = np.where(real, counts[entry], 0.0)  # what only fills up counts nothing
        near, mix = np.ascontiguousarray(given[entry].transpose(0, 2, 1)), mixes[live]
        for step in range(MOST_STEPS):
            share = n / np.matmul(mix[:, None, :], near)[:, 0]
            new = np.matmul(near, share[:, :, None])[:, :, 0] * mix + model.mix_prior
            new /= new.sum(axis=1, keepdims=True)
            mix, last = new, mix
            if step % 8 == 7 and not (moving := np.abs(mix - last).max(axis=1) > SETTLED).all():  # settled bags are left alone
                mixes[live] = mix
                near, n, live, mix = near[moving], n[moving], live[moving], mix[moving]
                if not len(live):
                    break
        mixes[live] = mix
    return mixes, (given * np.repeat(mixes, sizes, axis=0)).sum(axis=1)


def _blocks(batches):
    """(ids, starts, places, counts) of runs of bags."""
    for b in batches:
        ids, places, counts = (b.column(b.schema.get_field_index(n)) for n in ("id", "places", "counts"))
        ends = np.cumsum(np.asarray(places.value_lengths()))
        at = 0
        while at < len(ids):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_TERMS, side="right")))
            starts = np.r_[done, ends[at : to - 1]] - done
            yield ids.slice(at, to - at), starts, np.asarray(places.slice(at, to - at).flatten()), np.asarray(counts.slice(at, to - at).flatten()).astype(float)
            at = to


def expected(model: Topics, starts, places, counts) -> tuple[np.ndarray, float, float]:
    """Expected counts of topics and terms, the log-likelihood of the words, and the log prior of the mixes."""
    mixes, p = settle(model, starts, places, counts)
    each = np.repeat(mixes, np.diff(np.r_[starts, len(places)]), axis=0) * (counts / p)[:, None]
    sums = np.stack([np.bincount(places, np.maximum(w[places], LEAST) * e, len(w)) for w, e in zip(model.weights, each.T)])
    return sums, float(counts @ np.log(p)), float(model.mix_prior * np.log(np.maximum(mixes, LEAST)).sum())


def one_round(held: DataFrame, model: Topics) -> tuple[Topics, float, float, float]:
    """Better topics; and under the old ones the objective (log-likelihood and log priors), the log-likelihood and the number of words."""
    k, size = model.weights.shape

    def counted(batches):
        total = None
        for _, starts, places, counts in _blocks(batches):
            sums, likely, prior = expected(model, starts, places, counts)
            more = np.concatenate([sums.ravel(), [likely, prior, counts.sum()]])
            total = more if total is None else total + more
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "v"])

    sums = held.select("id", "places", "counts").mapInArrow(counted, "place long, v double").groupBy("place").agg(F.sum("v").alias("v"))
    got = np.zeros(k * size + 3)
    for r in sums.collect():
        got[r["place"]] = r["v"]
    likely, prior, words = got[-3:]
    prior += model.term_prior * np.log(np.maximum(model.weights, LEAST)).sum()
    new = got[:-3].reshape(k, size) + model.term_prior
    of = new.sum(axis=1, keepdims=True)
    weights = np.where(of > 0, new / np.maximum(of, LEAST), model.weights)
    return Topics(model.terms, weights, model.mix_prior, model.term_prior), float(likely + prior), float(likely), float(words)


def train(held: DataFrame, model: Topics, most_rounds: int, tolerance: float = 0.0) -> tuple[Topics, list[float]]:
    """The topics after at most ``most_rounds`` rounds, and the objective before each; stops when it gains no more than ``tolerance`` of itself.

    The bags are read in each round: cut their lineage before.
    """
    history = []
    for _ in range(most_rounds):
        model, objective, _, words = one_round(held, model)
        history.append(objective)
        if not words or (len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-1])):
            break
    return model, history


def perplexity(held: DataFrame, model: Topics) -> float:
    """exp of the mean negative log-probability of a word, each bag under its likeliest mix; infinite without words."""
    _, _, likely, words = one_round(held, model)
    return float(np.exp(-likely / words)) if words else float("inf")


def top_terms(model: Topics, n: int) -> list[tuple[int, int, str, float]]:
    """(topic, rank from 1, term, weight) of each topic's n heaviest terms, equal ones by their place in the vocabulary."""
    found = []
    for t, w in enumerate(model.weights):
        found += [(t, r, model.terms[i], float(w[i])) for r, i in enumerate(np.argsort(-w, kind="stable")[:n].tolist(), 1)]
    return found


def mixes(held: DataFrame, model: Topics) -> DataFrame:
    """Rows (id, shares): each bag's shares of the topics, in order."""

    def shared(batches):
        for ids, starts, places, counts in _blocks(batches):
            found, _ = settle(model, starts, places, counts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.tolist(), pa.list_(pa.float64()))], ["id", "shares"])

    kind = held.schema["id"].dataType.simpleString()
    return held.select("id", "places", "counts").mapInArrow(shared, f"id {kind}, shares array<double>")
