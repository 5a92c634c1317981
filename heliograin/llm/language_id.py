"""Operator 4: language identification by string kernels.

The kernel of two texts is the blended spectrum in its presence form: the
number of distinct n-grams (of the lengths ``NGRAMS``, in UTF-8 bytes of the
lower-cased letters and single spaces) that both hold, over the root of the
product of their own numbers. N-grams are hashed into ``BUCKETS`` places, so a text is a
row of presence bits and a batch of kernels is a matrix product.

Training draws at most ``MOST_PER_LANGUAGE`` labelled rows of each of at most ``MOST_LANGUAGES`` languages by
hash order, takes ``LANDMARKS`` of them as Nystroem landmarks and solves kernel
ridge regression one-versus-rest, with rows weighted so that languages count
alike. The sample's presence bits (BUCKETS / 8 bytes a row, at most ``MOST_ROWS`` rows) are
the only thing gathered on the driver. As the presence kernel is linear in the
bits, landmarks and weights fold into one BUCKETS x languages matrix, and
batches of whole texts are scored by one product with it.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is every row where nothing labelled can be learned from; a null language is
never learned; equal scores go to the first language in order; repeated rows
are predicted alike; an empty table gives an empty result; further columns are
ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAMS = (1, 2, 3, 4)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
LANDMARKS = 384
MOST_PER_LANGUAGE = 500
MOST_ROWS = 6000
#: More labels than this are an error, as each would be left too few rows.
MOST_LANGUAGES = MOST_ROWS // 4
RIDGE = 1e-3
#: Bytes and rows that are scored together: BUCKETS numbers a row.
BLOCK_BYTES, BLOCK_ROWS = 256 << 10, 256
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased letters, everything else as single spaces, a space at both ends; empty without a letter."""
    kept = F.btrim(F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))
    return F.when(F.length(kept) > 0, F.concat(F.lit(" "), kept, F.lit(" "))).otherwise(F.lit(""))


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence bits (rows x BUCKETS, bool) of the n-grams of each row."""
    n = len(offsets) - 1
    found = np.zeros(n * BUCKETS, bool)
    if not len(data):
        return found.reshape(n, BUCKETS)
    length = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, length)
    left = np.repeat(offsets[1:], length) - np.arange(len(data))  # bytes to the row's end
    code = np.zeros(len(data), np.uint64)
    for size in range(1, max(NGRAMS) + 1):
        here = len(data) - size + 1
        if here <= 0:
            break
        code = code[:here] * np.uint64(257) + data[size - 1 :].astype(np.uint64) + np.uint64(1)
        if size in NGRAMS:
            place = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            place += row[:here]
            found[place[left[:here] >= size]] = True
    return found.reshape(n, BUCKETS)


def _bits(batches):
    for b in batches:
        data, off = C.flat(b.column(2))
        for lo, hi in C.blocks(off, BLOCK_BYTES, BLOCK_ROWS):
            rows = np.packbits(presence(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "rank", "bits"])


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = MOST_PER_LANGUAGE):
    """Labels and presence bits of a bounded sample: at most ``most`` rows of a language, MOST_ROWS in all."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body")).filter("lang is not null and body is not null")
    labelled = labelled.withColumn("rank", F.xxhash64(F.lit(4), "id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    if not counts:
        return [], np.zeros((0, BUCKETS // 8), np.uint8)
    most = max(4, min(most, MOST_ROWS // len(counts)))
    # twice the share that is needed on average, then the first ones by rank
    entries = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * most + 20) / n))]
    drawn = labelled.filter(F.col("rank") < F.element_at(F.create_map(*entries), F.col("lang")))
    rows = drawn.select("lang", "rank", letters(F.col("body")).alias("body")).filter("body <> ''").mapInArrow(C.tidy(_bits), "lang string, rank double, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"], r["bits"]))
    taken, names, bits = dict.fromkeys(counts, 0), [], []
    for r in rows:
        if taken[r["lang"]] < most:
            taken[r["lang"]] += 1
            names.append(r["lang"])
            bits.append(np.frombuffer(r["bits"], np.uint8))
    return names, np.stack(bits) if bits else np.zeros((0, BUCKETS // 8), np.uint8)


def fit(names: list[str], bits: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and the BUCKETS x languages matrix that scores presence bits (after division by the root of their number)."""
    langs = sorted(set(names))
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    own = np.array([langs.index(x) for x in names])
    size = np.maximum(np.bitwise_count(bits).sum(axis=1, dtype=np.int64), 1)
    # landmarks: the first rows of each language in turn
    turn = np.empty(len(own), np.int64)
    for k in range(len(langs)):
        turn[own == k] = np.arange((own == k).sum())
    marks = np.sort(np.lexsort((own, turn))[:landmarks])
    phi = lambda rows: np.unpackbits(bits[rows], axis=1).astype(np.float32) / np.sqrt(size[rows])[:, None].astype(np.float32)
    at = phi(marks)
    k_nm = np.concatenate([phi(np.arange(lo, min(lo + 256, len(own)))) @ at.T for lo in range(0, len(own), 256)]).astype(np.float64)
    weight = 1.0 / np.bincount(own)[own]
    goal = (own[:, None] == np.arange(len(langs))).astype(np.float64)
    left = k_nm.T @ (k_nm * weight[:, None]) + ridge * (at @ at.T).astype(np.float64) + 1e-9 * np.eye(len(marks))
    alpha = np.linalg.lstsq(left, k_nm.T @ (goal * weight[:, None]), rcond=None)[0]
    return langs, (at.T @ alpha.astype(np.float32)).astype(np.float32)


def score(presence_rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows = presence_rows.astype(np.float32)
    return (rows @ weights) / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]


def _predictor(langs: list[str], weights: np.ndarray):
    def run(batches):
        for b in batches:
            data, off = C.flat(b.column(1))
            best = np.full(len(off) - 1, -1)
            top = np.zeros(len(off) - 1)
            if langs:
                for lo, hi in C.blocks(off, BLOCK_BYTES, BLOCK_ROWS):
                    s = score(presence(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), weights)
                    best[lo:hi] = s.argmax(axis=1)
                    top[lo:hi] = np.clip(s.max(axis=1), 0, 1)
            none = (np.diff(off) == 0) | (best < 0)
            top[none] = 0
            named = [UNKNOWN if x else langs[k] for x, k in zip(none, best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(top, pa.float64())], ["id", "lang_pred", "score"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """A model of the labelled rows that are not held out."""
    return fit(*sample(docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), id_col, text_col, lang_col))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score), a row for each row of ``docs``."""
    return docs.select(F.col(id_col).cast("long").alias("id"), letters(F.col(text_col)).alias("body")).mapInArrow(C.tidy(_predictor(*model)), "id long, lang_pred string, score double")


def accept(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", least: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose text has letters and a language that scores ``least`` or more, with their columns."""

    def keep(texts):
        data, off = C.flat(texts)
        good = np.zeros(len(off) - 1, bool)
        for lo, hi in C.blocks(off, BLOCK_BYTES, BLOCK_ROWS) if model[0] else ():
            good[lo:hi] = score(presence(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), model[1]).max(axis=1) >= least
        return good & (np.diff(off) > 0)

    return C.keep_rows(docs, letters(F.col(text_col)), keep)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
