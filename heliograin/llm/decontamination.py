"""Operator 5: benchmark decontamination by SimHash over item-sized windows.

Texts and items become lower-cased words of letters and digits. A match of the
threshold leaves an item's inner words alone but for a few: of m shingles at
most D = m * (1 - t) / (1 + t) are lost, one for a word at an end and five for
a word inside. So an item of n words is indexed by the 64-bit SimHash of all its
sub-windows of the largest class length up to n - D, which edits at its ends
leave whole, within 7 bits; and where D allows words inside to change, also by
those of the length of the longest run that must stay whole, within 3 bits. Every window
of a class length in every document is hashed by running sums over packed
counters. The 64 bits are four blocks of 16: fingerprints that differ in at
most 7 bits differ by at most one bit in some block, and those within 3 bits
agree in one, so an index of the blocks (with their one-bit variants) finds all pairs
within the radius. Each candidate names an item and where it would start; there, and where words put in or
left out may have moved it to, the multisets of five-word shingles are compared
exactly, by the sum of the lesser over the sum of the greater counts.

The documents are read once and not shuffled. The items go to the workers as
broadcasts of ``PART_BYTES`` at most, gathered one at a time, each with a pass of its own.

Defined results: null or empty texts and items match nothing; an item of fewer
than five words is one shingle of all its words; the best window of each
document and item is told, the first of equals; equal rows are told each;
an empty table, either of the two, gives an empty result; further columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD, SHINGLE = 0.8, 5
BLOCKS, BLOCK_BITS = 4, 16
#: Bits that may differ in windows of the item's size, and in those of runs that stay whole.
RADIUS, RUN_RADIUS = 2 * BLOCKS - 1, BLOCKS - 1
#: Ratio of neighbouring class lengths, and the longest.
STEP, LONGEST = 1.2, 32_000
PART_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
SPAN = 1 << 18
#: Candidate pairs and ranges that are held at once.
PAIRS = 1 << 21
_H = C.Hasher(5)
_BASE = 0x9E3779B97F4A7C15


def normal(text: Column) -> Column:
    """Lower-cased words of letters and digits, joined by one space."""
    return F.coalesce(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+", " "), F.lit(""))


def _spread(values: int, lanes: int, width: int) -> np.ndarray:
    return np.array([sum(((v >> k) & 1) << (width * k) for k in range(lanes)) for v in range(values)], dtype=np.uint64)


_BY_BYTE, _BY_NIBBLE = _spread(256, 8, 8), _spread(16, 4, 16)


class Sums:
    """Running sums of the bits of word hashes, several counters to a number.

    A window's sums are differences of two of them, exact as long as no counter
    of the window itself overflows: 127 words with 8-bit counters, 32,767 with 16-bit ones.
    """

    def __init__(self, h: np.ndarray):
        self.h, self.made = h, {}

    def _sums(self, wide: bool) -> list[np.ndarray]:
        if wide not in self.made:
            lanes = self.h.astype("<u8").view(np.uint8).reshape(-1, 8)
            if wide:
                parts = [_BY_NIBBLE[(lanes[:, k // 2] >> (4 * (k % 2))) & 15] for k in range(16)]
            else:
                parts = [_BY_BYTE[lanes[:, k]] for k in range(8)]
            self.made[wide] = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(p)]) for p in parts]
        return self.made[wide]

    def fingerprints(self, length: int) -> np.ndarray:
        """SimHash of each window of ``length`` words: a bit is set where over half of the words have it."""
        if len(self.h) < length:
            return np.empty(0, np.uint64)
        wide = length > 127
        width = 16 if wide else 8
        each = sum(1 << (width * k) for k in range(64 // width))
        lift = np.uint64(((1 << (width - 1)) - 1 - length // 2) * each)
        tops = np.uint64(each << (width - 1))
        gather = np.uint64(sum(1 << ((64 - width) - (width - 1) * k) for k in range(64 // width)))
        out = np.zeros(len(self.h) - length + 1, np.uint64)
        for k, s in enumerate(self._sums(wide)):
            d = s[length:] - s[:-length]
            d += lift
            d &= tops
            d >>= np.uint64(width - 1)
            d *= gather
            d >>= np.uint64(64 - width)
            if wide:
                d &= np.uint64(15)
            d <<= np.uint64(k * 64 // len(self._sums(wide)))
            out |= d
        return out


def shingles(h: np.ndarray) -> Counter:
    """The multiset of five-word shingles of word hashes; of fewer words, one of all."""
    n = len(h) - SHINGLE + 1
    if n < 1:
        return Counter([tuple(h.tolist())]) if len(h) else Counter()
    g = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        g = g * np.uint64(_BASE) + h[k : k + n]
    return Counter(C.mix(g).tolist())


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (a.total() + b.total() - both) if both else 0.0


def hashes(texts: list[str]) -> list[np.ndarray]:
    data, off = C.flat(pa.array(texts, pa.string()))
    starts, ends, first = C.words(data, off)
    h = _H.words(data, starts, ends)
    return [h[a:b] for a, b in zip(first, first[1:])]


def spared(n: int, threshold: float) -> tuple[int, int, int]:
    """Of an item of n words, what a match leaves: the words that edits at its ends spare, the longest run that all edits spare, and how many words inside may change."""
    lost = int(max(n - SHINGLE + 1, 1) * (1 - threshold) / (1 + threshold) + 1e-9)
    inside = lost // SHINGLE
    run = min((n - (lost - SHINGLE * e) - e) // (e + 1) for e in range(inside + 1))
    return max(n - lost, 1), max(run, 1), inside


class Index:
    """Items by class length, and each class's fingerprints by 16-bit block (with one-bit variants for the wider radius)."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        made = [(name, h) for (name, _), h in zip(items, hashes([t for _, t in items])) if len(h)]
        self.names = [name for name, _ in made]
        self.items = [h for _, h in made]
        self.counts = [shingles(h) for h in self.items]
        left = [spared(len(h), threshold) for h in self.items]
        self.moved = [inside for *_, inside in left]
        wanted = [(i, min(ends, LONGEST), RADIUS) for i, (ends, _, _) in enumerate(left)]
        wanted += [(i, min(run, LONGEST), RUN_RADIUS) for i, (_, run, inside) in enumerate(left) if inside]
        sizes: list[int] = []
        for n in sorted({n for _, n, _ in wanted}):
            if not sizes or n > sizes[-1] * STEP:
                sizes.append(n)
        self.classes = {}
        for size, beyond in zip(sizes, [*sizes[1:], LONGEST + 1]):
            for radius in (RADIUS, RUN_RADIUS):
                mine = [i for i, n, r in wanted if r == radius and size <= n < beyond]
                if mine:
                    fps = [Sums(self.items[i]).fingerprints(size) for i in mine]
                    item, offset = np.repeat(mine, [len(f) for f in fps]), np.concatenate([np.arange(len(f)) for f in fps])
                    self.classes.setdefault(size, []).append(self._class(np.concatenate(fps), item, offset, radius))

    @staticmethod
    def _class(fps, item, offset, radius):
        # neighbouring windows of an item that have one fingerprint are one entry, with its first and last offset
        first = np.flatnonzero(np.r_[True, (fps[1:] != fps[:-1]) | (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)])
        last = np.r_[first[1:], len(fps)] - 1
        fps, item, offset = fps[first], item[first], (offset[first], offset[last])
        variants = np.array([0, *[1 << k for k in range(BLOCK_BITS)]] if radius == RADIUS else [0], np.uint16)
        blocks, parts = [], fps.astype("<u8").view(np.uint16).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            keys = (parts[:, b, None] ^ variants).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            upto = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
            blocks.append((np.diff(upto) > 0, upto, order // len(variants)))
        return fps, item, offset, blocks, radius


def candidates(found: np.ndarray, index):
    """Pairs (window, entry) of a class within the radius, in parts of about PAIRS; a pair may come once for each block."""
    fps, _, _, blocks, radius = index
    parts = found.astype("<u8").view(np.uint16).reshape(-1, BLOCKS)
    for b, (there, upto, order) in enumerate(blocks):
        at = np.flatnonzero(there[parts[:, b]])
        key = parts[at, b].astype(np.int64)
        n = upto[key + 1] - upto[key]
        sums = np.r_[0, np.cumsum(n)]
        for lo, hi in C.blocks(sums, PAIRS):
            m = n[lo:hi]
            w = np.repeat(at[lo:hi], m)
            e = order[np.repeat(upto[key[lo:hi]] - (sums[lo:hi] - sums[lo]), m) + np.arange(m.sum())]
            near = np.bitwise_count(found[w] ^ fps[e]) <= radius
            if near.any():
                yield w[near], e[near]


def united(row, item, lo, hi):
    """Ranges of starts of each row and item, overlapping and adjoining ones united."""
    order = np.lexsort((lo, item, row))
    row, item, lo, hi = row[order], item[order], lo[order], hi[order]
    apart = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
    lift = np.cumsum(apart) * (int(hi.max()) - int(lo.min()) + 3)
    most = np.maximum.accumulate(hi + lift)
    first = np.flatnonzero(np.r_[True, lo[1:] + lift[1:] > most[:-1] + 1])
    return row[first], item[first], lo[first], (most - lift)[np.r_[first[1:], len(row)] - 1]


def best_start(h: np.ndarray, f: int, e: int, n: int, counts: Counter, lo: int, hi: int):
    """(similarity, start, end) of the most similar, then first, window of an item's n words that starts from lo to hi, inside words f to e."""
    top = (0.0, 0, 0)
    if n < SHINGLE:
        for s in range(max(lo, f - n + 1), min(hi, e - 1) + 1):
            a, z = max(s, f), min(s + n, e)
            top = max(top, (similarity(counts, shingles(h[a:z])), a, z), key=lambda x: (x[0], -x[1]))
        return top
    base, end = max(lo, f), min(hi + n, e)
    if end - base < SHINGLE:
        return top
    g = np.zeros(end - base - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        g = g * np.uint64(_BASE) + h[base + k : base + k + len(g)]
    g, total = C.mix(g).tolist(), counts.total()
    have: dict[int, int] = {}
    both, x, y = 0, base, base
    for s in range(max(lo, f - n + 1), min(hi, e - 1) + 1):
        a, z = max(s, f), min(s + n, e) - SHINGLE + 1
        while y < z:  # comes in
            k = g[y - base]
            y += 1
            if k in counts:
                have[k] = c = have.get(k, 0) + 1
                both += c <= counts[k]
        while x < min(a, y):  # goes out
            k = g[x - base]
            x += 1
            if k in counts:
                c = have[k]
                have[k] = c - 1
                both -= c <= counts[k]
        if both and z > a:
            value = both / (total + z - a - both)
            if value > top[0]:
                top = (value, a, z + SHINGLE - 1)
    return top


def scan(h: np.ndarray, first: np.ndarray, index: Index, threshold: float):
    """(row, item, similarity, start, end) of the best window of each row and item it matches.

    Windows that stand side by side with one fingerprint are tried as one, and what
    they say about an item's start are ranges, along which the shingle counts slide: a text or an item that
    repeats itself costs no more than its length.
    """
    best: dict[tuple[int, object], tuple[float, int, int]] = {}
    if not len(h) or not index.classes:
        return best
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    longest, ranges, held = max(index.classes), [], 0
    moved = np.array(index.moved, np.int64)
    for lo in range(0, len(h), SPAN):
        sums = Sums(h[lo : lo + SPAN + longest - 1])
        for size, indexes in index.classes.items():
            fps = sums.fingerprints(size)[:SPAN]
            if not len(fps):
                continue
            at = np.arange(lo, lo + len(fps))
            at = at[at + size <= first[1:][row_of[lo : lo + len(fps)]]]
            if not len(at):
                continue
            print_ = fps[at - lo]
            begin = np.flatnonzero(np.r_[True, (print_[1:] != print_[:-1]) | (at[1:] != at[:-1] + 1) | (row_of[at[1:]] != row_of[at[:-1]])])
            final = at[np.r_[begin[1:], len(at)] - 1]
            for kept in indexes:
                for w, e in candidates(print_[begin], kept):
                    item = kept[1][e]
                    ranges.append(united(row_of[at[begin[w]]], item, at[begin[w]] - kept[2][1][e] - moved[item], final[w] - kept[2][0][e] + moved[item]))
                    held += len(ranges[-1][0])
                    if held > PAIRS:
                        ranges = [united(*map(np.concatenate, zip(*ranges)))]
                        held = len(ranges[0][0])
    if not ranges:
        return best
    # words put in or left out before a window move the item's start: the ranges are wider by what may be
    for r, i, a, z in zip(*(x.tolist() for x in united(*map(np.concatenate, zip(*ranges))))):
        value, s, e = best_start(h, int(first[r]), int(first[r + 1]), len(index.items[i]), index.counts[i], a, z)
        if value >= threshold:
            now = (value, s - int(first[r]), e - int(first[r]))
            was = best.get((r, index.names[i]))
            if was is None or (-now[0], now[1]) < (-was[0], was[1]):
                best[r, index.names[i]] = now
    return best


def _scanner(items: Broadcast, threshold: float):
    """A function of a text column: yields (first row, matches) of each block of rows."""
    held: list[Index] = []

    def each(texts):
        if not held:
            held.append(Index(items.value, threshold))
        data, off = C.flat(texts)
        for lo, hi in C.blocks(off, BLOCK_BYTES):
            part = data[off[lo] : off[hi]]
            starts, ends, first = C.words(part, off[lo : hi + 1] - off[lo])
            yield lo, scan(_H.words(part, starts, ends), first, held[0], threshold)

    return each


def benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str, most: int = PART_BYTES):
    """The items as broadcasts of about ``most`` bytes at most; the driver gathers one at a time and keeps none."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), normal(F.col(text_col)).alias("body"))
    size = C.text_bytes(items, "body")
    n = max(1, -(-2 * size // most)) if size > most else 1
    items = C.cut(items.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(n)))) if n > 1 else items.withColumn("part", F.lit(0))
    for k in range(n):
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["body"]) for r in items.filter(F.col("part") == k).orderBy("item", "body").collect()])


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows (id, item, similarity, start, end): the best window of each document and item; word positions, end exclusive."""
    body = docs.select(F.col(id_col).cast("long").alias("id"), normal(F.col(text_col)).alias("body"))

    def scanned(items):
        each = _scanner(items, threshold)

        def run(batches):
            for b in batches:
                for lo, best in each(b.column(1)):
                    if best:
                        rows = sorted(best, key=lambda k: (k[0], str(k[1])))
                        yield pa.RecordBatch.from_arrays(
                            [
                                b.column(0).take(pa.array([lo + r for r, _ in rows])),
                                pa.array([i for _, i in rows], pa.int64()),
                                pa.array([best[k][0] for k in rows], pa.float64()),
                                pa.array([best[k][1] for k in rows], pa.int64()),
                                pa.array([best[k][2] for k in rows], pa.int64()),
                            ],
                            ["id", "item", "similarity", "start", "end"],
                        )

        return body.mapInArrow(C.tidy(run), "id long, item long, similarity double, start long, end long")

    return reduce(DataFrame.union, map(scanned, benchmark_parts(benchmark, item_col, item_text_col)))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    for items in benchmark_parts(benchmark, item_col, item_text_col):
        each = _scanner(items, threshold)

        def keep(texts, each=each):
            mask = np.ones(len(texts), bool)
            for lo, best in each(texts):
                mask[[lo + r for r, _ in best]] = False
            return mask

        docs = C.keep_rows(docs, normal(F.col(text_col)), keep)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), F.col("start").alias("start_word"), F.col("end").alias("end_word")
    )
