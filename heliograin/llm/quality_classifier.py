"""Operator 12: quality classifier by naive Bayes support vectors.

A text sets indicators of its n-grams: of one to three bytes of the text, and
of one to three words' shapes (case, digits, other letters, last byte's kind,
and whether the word repeats the one before). They are hashed into DIMENSIONS places.

Training rows are all labelled rows of the caller's choice. Over all of them one
aggregate counts, for each place, the rows of either class that set it. The
class log-count ratio of a place is r = log((p / |p|) / (q / |q|)) with smoothed
counts p and q. Each indicator is scaled by its ratio; on the scaled ones, brought to unit length, a
linear model of the hinge loss is fitted by dual coordinate descent (L1 loss,
box constraint COST, a bias), on at most MOST_ROWS rows of either class,
chosen by a hash of id and text. The weights are then drawn towards their mean size (BETA).

Scoring is one pass over the texts without a shuffle: the weights of the places
that a text sets are summed, divided by the length of its scaled vector; the score is the
logistic function of that margin.

Defined results: a null text scores like an empty one (the bias alone); rows
with a null or other label than 0 and 1 aren't trained on; a document with several
label rows has the largest; a null id is not labelled and not held out; equal rows score alike;
without rows of both classes every score is 0.5 (no rows), 1 or 0 (the class that there is); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 17
DIMENSIONS = 1 << BITS
NGRAMS = 3
#: Rows of either class that the hinge-loss model is fitted on; the counts cover all labelled rows.
MOST_ROWS = 3000
SMOOTHING = 1.0
COST = 1.0
BETA = 0.25
EPOCHS = 40
#: The margin's factor in the logistic function.
STEEPNESS = 4.0
BLOCK_BYTES, BLOCK_ROWS = 256 << 10, 128

_KIND = np.zeros(256, np.int64)  # of a word's last byte: 0 other, 1 letter, 2 digit, 3 . , 4 , ; : , 5 ! ? , 6 other marks, 7 byte of a longer code point
_KIND[33:127] = 6
for _bytes, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1), (b"0123456789", 2), (b".", 3), (b",;:", 4), (b"!?", 5)):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 7
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_HASHER = C.Hasher(12)


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number below 256 for each word, and each row's first word."""
    starts, ends, first = C.words(data, offsets)
    if not len(starts):
        return np.empty(0, np.int64), first
    some = lambda mask: np.add.reduceat(mask[data].astype(np.int32), np.stack([starts, ends], 1).ravel()[: 2 * len(starts) - (ends[-1] == len(data))])[::2] > 0
    hashes = _HASHER.words(data, starts, ends)
    again = np.r_[False, hashes[1:] == hashes[:-1]]
    again[first[:-1][first[:-1] < len(starts)]] = False
    flags = (some(_UPPER), some(_LOWER), some(_DIGIT), again, ends - starts > 40)
    return _KIND[data[ends - 1]] + sum(f.astype(np.int64) << (3 + k) for k, f in enumerate(flags)), first


def _grams(codes: np.ndarray, base: int, offsets: np.ndarray, row: np.ndarray, salt: int, found: np.ndarray):
    """Sets in ``found`` the places of all n-grams of ``codes`` that stay inside their row."""
    left = offsets[1:][row] - np.arange(len(codes))
    code = np.zeros(len(codes), np.uint64)
    for size in range(1, NGRAMS + 1):
        here = len(codes) - size + 1
        if here <= 0:
            break
        code = code[:here] * np.uint64(base) + codes[size - 1 :].astype(np.uint64) + np.uint64(1)
        place = (((code + np.uint64(salt + size)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        inside = left[:here] >= size
        found[(row[:here][inside] << BITS) + place[inside]] = True


def indicators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted row * DIMENSIONS + place of the indicators that the rows set."""
    n = len(offsets) - 1
    found = np.zeros(n << BITS, bool)
    if len(data):
        _grams(data, 257, offsets, np.repeat(np.arange(n), np.diff(offsets)), 0, found)
        codes, first = shapes(data, offsets)
        _grams(codes, 257, first, np.repeat(np.arange(n), np.diff(first)), 1 << 40, found)
    return np.flatnonzero(found)


def _blocks(texts):
    data, off = C.flat(texts)
    for lo, hi in C.blocks(off, BLOCK_BYTES, BLOCK_ROWS):
        yield lo, hi, indicators(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def _count(batches):
    seen = np.zeros((2, DIMENSIONS), np.int64)
    rows = np.zeros(2, np.int64)
    for b in batches:
        good = b.column(0).to_numpy().astype(np.int64)
        rows += np.bincount(good, minlength=2)
        for lo, hi, found in _blocks(b.column(1)):
            seen += np.bincount((good[lo + (found >> BITS)] << BITS) + (found & (DIMENSIONS - 1)), minlength=2 << BITS).reshape(2, -1)
    place = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[place, -1]), pa.array(np.r_[seen[0, place], rows[0]]), pa.array(np.r_[seen[1, place], rows[1]])], ["place", "bad", "good"])


def _bits(batches):
    for b in batches:
        for lo, hi, found in _blocks(b.column(1)):
            ends = np.searchsorted(found, np.arange(hi - lo + 1) << BITS)
            packed = []
            for k in range(hi - lo):
                set_ = np.zeros(DIMENSIONS, bool)
                set_[found[ends[k] : ends[k + 1]] & (DIMENSIONS - 1)] = True
                packed.append(zlib.compress(np.packbits(set_).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(packed, pa.binary())], ["good", "bits"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows (id, good, body) of the documents with a label."""
    table = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("good")).filter("of is not null and good in (0, 1)")
    table = table.groupBy("of").agg(F.max("good").alias("good"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).filter("id is not null")
    if table.count() * 16 <= C.BROADCAST_BYTES:
        table = F.broadcast(table)
    return rows.join(table, F.col("id") == F.col("of")).select("id", "good", "body")


def log_ratios(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places' class log-count ratios, and the rows of either class."""
    place, bad, good = (counts.column(k).to_numpy() for k in ("place", "bad", "good"))
    rows = np.array([bad[place < 0].sum(), good[place < 0].sum()])
    p, q = np.full(DIMENSIONS, SMOOTHING), np.full(DIMENSIONS, SMOOTHING)
    p[place[place >= 0]] += good[place >= 0]
    q[place[place >= 0]] += bad[place >= 0]
    return np.log((p / p.sum()) / (q / q.sum())), rows


def descend(vectors: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, dimensions: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 12) -> np.ndarray:
    """Weights of the hinge loss by dual coordinate descent over sparse rows (places, values); sign is 1 or -1."""
    w = np.zeros(dimensions)
    alpha = np.zeros(len(vectors))
    size = [float(v @ v) for _, v in vectors]
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(vectors)):
            at, v = vectors[k]
            if not size[k]:
                continue
            slope = sign[k] * float(w[at] @ v) - 1.0
            step = min(max(alpha[k] - slope / size[k], 0.0), cost) - alpha[k]
            if step:
                alpha[k] += step
                w[at] += (step * sign[k]) * v
                most = max(most, abs(step) * size[k])
        if most < 1e-3:
            break
    return w


def fit(rows: list[tuple[int, np.ndarray]], ratios: np.ndarray) -> np.ndarray:
    """Weights of the DIMENSIONS places and the bias, of rows (good, places)."""
    vectors = []
    for _, at in rows:
        v = ratios[at]
        v = v / max(np.sqrt(v @ v), 1e-12)
        vectors.append((np.r_[at, DIMENSIONS], np.r_[v, 1.0]))
    sign = np.array([1.0 if good else -1.0 for good, _ in rows])
    w = descend(vectors, sign, DIMENSIONS + 1)
    part = w[:DIMENSIONS]
    used = part != 0
    if used.any():
        # towards the mean size, in the direction that the ratio gives
        w[:DIMENSIONS] = np.where(used, (1 - BETA) * part + BETA * np.abs(part[used]).mean() * np.sign(part), 0.0)
    return w


def train(rows: DataFrame, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Ratios, weights and, where there is no model, the score of all texts; of rows (id, good, body)."""
    counts = rows.select("good", "body").mapInArrow(C.tidy(_count), "place long, bad long, good long")
    counts = counts.groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    ratios, n = log_ratios(counts)
    none = np.zeros(DIMENSIONS + 1)
    if not n.all():
        return ratios, none, 0.5 if not n.any() else float(n[1] > 0)
    part = F.xxhash64(F.lit(12), "id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = []
    for good in (0, 1):
        # twice the share that is needed on average, then the first ones
        share = min(1.0, (2 * most + 20) / int(n[good]))
        some = rows.filter((F.col("good") == good) & (part < share)).withColumn("part", part)
        some = some.orderBy("part", F.xxhash64("body")).limit(most).select("good", "body")
        found = some.mapInArrow(C.tidy(_bits), "good int, bits binary").collect()
        drawn += [(r["good"], np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8)))) for r in found]
    drawn.sort(key=lambda x: (x[0], x[1].tobytes()))
    return ratios, fit(drawn, ratios), None


def _scorer(ratios: np.ndarray, weights: np.ndarray, constant: float | None):
    pair = np.stack([weights[:DIMENSIONS] * ratios, ratios * ratios], axis=1)
    bias = weights[DIMENSIONS]

    def run(batches):
        for b in batches:
            score = np.full(b.num_rows, 0.5 if constant is None else constant)
            for lo, hi, found in _blocks(b.column(1)) if constant is None else ():
                row, both = found >> BITS, pair[found & (DIMENSIONS - 1)]
                total, size = (np.bincount(row, both[:, k], hi - lo) for k in (0, 1))
                score[lo:hi] = 1 / (1 + np.exp(-STEEPNESS * (bias + total / np.sqrt(np.maximum(size, 1e-12)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["id", "score"])

    return run


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted), a row for each row of ``docs``."""
    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(C.tidy(_scorer(*model)), "id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(labelled(docs.filter(~held_out(F.col("doc_id"))), C.table(spark, sf_dir, "labels")))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted")
