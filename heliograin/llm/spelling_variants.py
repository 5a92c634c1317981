"""Operator 11: spelling variant grouping.

Words are counted over the whole texts: runs of letters, with a hash-chosen
share of them losing one code point, of a least length and a least count. Two
words are near if one inserted, deleted or replaced code point turns one into
the other. Such an edit leaves a half of the shorter word intact. So the words
stand in a forward dictionary, sorted by their first half, and in a reversed
one, sorted by their last half read backwards; near words share a block of one of them.

A block is (m, lo, hi): words of m and of m + 1 code points that share the first
``lo`` and the last ``m - hi`` code points. It answers for the pairs whose first
difference stands at ``lo`` or later and before ``hi``. Every pair has one such
place, so it is counted in one block alone. A block is subdivided at the middle
of its range: into the words that also share the code points up to there, and those that
share the ones from there on. Blocks over MOST_WORDS words or MOST_CELLS code points are
subdivided by Spark before they are dealt out, so none is gathered whole; the others are dealt
in sorted order (range partitions), scanned, subdivided further down to
SMALL words and verified exactly. At a range of one place all words of a block are near.

A task gives back for each word how many near words it saw and the best one; they are
summed by word. A chain of forms grows by a factor in count at each step, so
the number of joins that lead to the roots follows from the largest count.

Defined results: null and empty texts have no words; a null id reads as an
empty one in the hash; equal rows count each; words of any length are whole;
without near words n_near is 0, form is null and the word is its own root; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LENGTH = 7
LEAST_COUNT = 2
DAMAGE = 31
#: A form has at least so many times the word's count.
TIMES = 10
MOST_WORDS = 4096
MOST_CELLS = 1 << 20
SMALL = 12
#: Code points that a task holds and compares at once.
RUN_CELLS = 1 << 20
BLOCK = ["m", "lo", "hi", "key"]


def damaged(doc_id: Column, run: Column, every: int = DAMAGE) -> Column:
    """The lower-cased run, without one code point where the hash of id and run is a multiple of ``every``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of the words of all texts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # a maximal run of fewer letters can't become a word
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.col(id_col).alias("id"), found.alias("run")).select("id", F.translate("run", upper, lower).alias("run"))
    words = runs.select(damaged(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _block_key(word: Column, m: Column, lo: Column, hi: Column) -> Column:
    kept = F.greatest(m - hi, F.lit(0))
    # (the empty suffix has to be told apart: right() of 0 code points)
    return F.concat(F.substring(word, F.lit(1), lo), F.when(kept > 0, F.reverse(F.right(word, kept))).otherwise(F.lit("")))


def _placed(rows: DataFrame, blocks: Column) -> DataFrame:
    made = rows.select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.m", "b.lo", "b.hi")
    return made.withColumn("key", _block_key(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")))


def _range(m: Column, lo: Column, hi: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def halves(words: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi, key): each word in its blocks of both dictionaries, as the shorter and as the longer word."""
    size = F.length("word")
    ranges = [r for m in (size, size - 1) for half in [F.floor(m / 2)] for r in (_range(m, half, m + 1), _range(m, F.lit(0), half))]
    return _placed(words, F.array(*ranges))


def subdivided(rows: DataFrame, most_words: int = MOST_WORDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """``rows`` in blocks of bounded size, or of one place."""
    done = []
    while True:
        sized = rows.groupBy(*BLOCK).agg(F.count("*").alias("in_block")).filter("hi - lo > 1")
        large = C.cut(sized.filter((F.col("in_block") > most_words) | ((F.col("in_block") > 1) & (F.col("in_block") * (F.col("m") + 1) > most_cells))))
        if large.isEmpty():
            done.append(rows)
            break
        large = large.select(F.struct(*BLOCK).alias("of"), "in_block")
        met = C.meet(rows, F.struct(*BLOCK), large, "of", "in_block", F.octet_length("of.key") + F.lit(40))
        done.append(met.filter("in_block is null").drop("of", "in_block"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        parts = F.array(_range(F.col("m"), F.col("lo"), mid), _range(F.col("m"), mid, F.col("hi")))
        rows = C.cut(_placed(met.filter("in_block is not null").drop("of", "in_block", "key"), parts))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


class _Run:
    """Words of blocks of one (m, lo, hi), subdivided and compared."""

    def __init__(self, words: list[str], counts: np.ndarray, blocks: np.ndarray, m: int, lo: int, hi: int):
        self.m, n = m, len(words)
        self.ahead = np.array(words, dtype=f"<U{m + 1}").view(np.uint32).reshape(n, m + 1)
        self.long = self.ahead[:, m] != 0
        self.back = self.ahead[:, ::-1].copy()  # read backwards, the shorter words moved to the front
        self.back[~self.long, :m] = self.back[~self.long, 1:]
        self.back[~self.long, m] = 0
        self.factors = np.random.Generator(np.random.PCG64(11)).integers(1 << 32, 1 << 63, m + 1, dtype=np.uint64) | np.uint64(1)
        self.near = np.zeros(n, np.int64)
        self.best = np.full(n, -1, np.int64)
        # rank of each word as a form: larger count, then smaller word
        by_word = np.empty(n, np.int64)
        by_word[np.array(sorted(range(n), key=words.__getitem__))] = np.arange(n)
        self.rank = np.empty(n, np.int64)
        self.rank[np.lexsort((by_word, -counts))] = np.arange(n)
        self.owner = np.argsort(self.rank)
        self.best_rank = np.full(n, n, np.int64)
        todo = [(np.arange(n), blocks, lo, hi)]
        while todo:
            todo += self.step(*todo.pop())
        seen = self.best_rank < n
        self.best[seen] = self.owner[self.best_rank[seen]]

    def step(self, rows, block, lo, hi):
        """Compares small blocks and those of one place; returns the halves of the others."""
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        size = np.diff(np.r_[first, len(block)])
        whole = np.repeat(size, size)
        here = (whole > 1) & ((whole <= SMALL) | (hi - lo == 1))
        self.compare(rows[here], block[here], lo, hi)
        rest = (whole > 1) & ~here
        if not rest.any():
            return []
        rows, block, mid, m = rows[rest], block[rest], (lo + hi) // 2, self.m
        return [
            self.grouped(rows, block, self.back[rows, max(m - hi, 0) : max(m - mid, 0)], lo, mid),
            self.grouped(rows, block, self.ahead[rows, lo:mid], mid, hi),
        ]

    def grouped(self, rows, block, shared, lo, hi):
        """Equal keys only merge blocks when they collide, as every pair is verified."""
        mark = C.mix((shared.astype(np.uint64) * self.factors[: shared.shape[1]]).sum(axis=1, dtype=np.uint64) + C.mix(block.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(mark, kind="stable")
        return rows[order], mark[order], lo, hi

    def compare(self, rows, block, lo, hi):
        step = 1
        at = np.arange(len(rows) - 1)
        most = max(1, RUN_CELLS // (self.m + 1))
        while len(at := at[at + step < len(rows)]) and len(at := at[block[at] == block[at + step]]):
            for k in range(0, len(at), most):
                a, b = rows[at[k : k + most]], rows[at[k : k + most] + step]
                some = ~(self.long[a] & self.long[b])  # two long words meet where they are the shorter ones
                self.verify(a[some], b[some], lo, hi)
            step += 1

    def verify(self, a, b, lo, hi):
        differs = self.ahead[a] != self.ahead[b]
        place = differs.argmax(axis=1)  # the words are distinct
        inside = (place >= lo) & (place < hi)
        mixed = self.long[a] != self.long[b]
        replaced = inside & ~mixed & (differs.sum(axis=1) == 1)
        at = np.flatnonzero(inside & mixed)
        if len(at):
            backwards = (self.back[a[at]] != self.back[b[at]]).argmax(axis=1)
            replaced[at[place[at] + backwards >= self.m]] = True
        a, b = a[replaced], b[replaced]
        for x, y in ((a, b), (b, a)):
            np.add.at(self.near, x, 1)
            np.minimum.at(self.best_rank, x, self.rank[y])


def _scan(batches):
    """Blocks come sorted and whole; runs of blocks of one (m, lo, hi) are compared together."""

    def compared(table: pa.Table, m, lo, hi):
        words, n = table.column(0).to_pylist(), table.column(1).to_numpy()
        key = table.column(5).combine_chunks()
        key = key.dictionary_encode().indices.to_numpy().astype(np.int64)
        run = _Run(words, n, key, m, lo, hi)
        seen = np.flatnonzero(run.near)
        best = run.best[seen]
        words = np.array(words, dtype=object)
        columns = [pa.array(words[seen], pa.string()), pa.array(run.near[seen]), pa.array(n[best]), pa.array(words[best], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form_n", "form"])

    def starts_of(table: pa.Table) -> np.ndarray:
        """First rows of the blocks."""
        moved = np.zeros(table.num_rows, bool)
        moved[:1] = True
        for k in (2, 3, 4):
            v = table.column(k).to_numpy()
            moved[1:] |= v[1:] != v[:-1]
        key = table.column(5).combine_chunks().dictionary_encode().indices.to_numpy()
        moved[1:] |= key[1:] != key[:-1]
        return np.flatnonzero(moved)

    def whole_blocks(table: pa.Table, last: bool):
        """Compares what is complete; returns the rest."""
        starts = starts_of(table)
        ends = np.r_[starts[1:], table.num_rows]
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        shape = np.stack([table.column(k).to_numpy() for k in (2, 3, 4)], axis=1)
        k = 0
        while k < len(starts):
            m, lo, hi = (int(x) for x in shape[starts[k]])
            j = k + 1
            while j < len(starts) and (ends[j] - starts[k]) * (m + 1) <= RUN_CELLS and (shape[starts[j]] == (m, lo, hi)).all():
                j += 1
            if ends[j - 1] - starts[k] > j - k:  # else single words
                yield compared(table.slice(starts[k], ends[j - 1] - starts[k]), m, lo, hi)
            k = j
        return table.slice(table.num_rows if not len(ends) and last else (ends[-1] if len(ends) else 0))

    held, cells = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        if held.num_rows * (held.column(2)[held.num_rows - 1].as_py() + 1) > 2 * RUN_CELLS:
            held = yield from whole_blocks(held, False)
    if held is not None and held.num_rows:
        yield from whole_blocks(held, True)


def near_words(words: DataFrame, most_words: int = MOST_WORDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """Rows (word, n_near, form, form_n) of the words that have near ones: how many, and the one of largest count."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = subdivided(halves(words), most_words, most_cells)
    rows = rows.repartitionByRange(parts, *BLOCK).sortWithinPartitions(*BLOCK).select("word", "n", *BLOCK)
    seen = rows.mapInArrow(C.tidy(_scan), "word string, n_near long, form_n long, form string")
    # the largest count, among equals the smallest word
    best = F.min_by(F.struct("form", "form_n"), F.struct((-F.col("form_n")).alias("less"), "form"))
    return seen.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", "best.form_n")


def group_variants(words: DataFrame, times: int = TIMES, most_words: int = MOST_WORDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) for rows (word, n)."""
    words = C.cut(words.select("word", "n"))
    near = near_words(words, most_words, most_cells)
    known = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    good = F.col("form_n") >= F.col("n") * times
    known = C.cut(known.withColumns({"form": F.when(good, F.col("form")), "form_n": F.when(good, F.col("form_n"))}))
    top = known.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(top, 2), times)))  # longest chain
    roots = known.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = C.cut(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(count_words(C.table(spark, sf_dir, "documents")))
