"""Helpers shared by the operators of this subpackage.

Words are runs of bytes other than the six ASCII white-space bytes, in whole
UTF-8 texts. The array helpers work on one Arrow batch at a time, in blocks of
bounded bytes, so a worker's memory follows the block and the longest single
text, never the partition.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 2 << 20
#: A table joined to all rows is broadcast up to this size; beyond it only its rows for keys with over 1 / HOT_KEYS of all rows are.
BROADCAST_BYTES = 8 << 20
HOT_KEYS = 200

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder under /tmp only where none is named and all runs on this machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows; sizes group counts."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def running(df: DataFrame, order: list[Column], **values) -> DataFrame:
    """``df`` with ``before_<name>`` for each of ``values``: its sum over all rows that come earlier in ``order``.

    ``order`` has to tell rows apart. Rows are range-partitioned and written once,
    sums run inside the partitions, and each partition starts from the sums of
    those before it (a window over one row for each partition), so no task sorts all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({f"_{k}": v for k, v in values.items()}).repartitionByRange(parts, *order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()))
    earlier = W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("_part").alias("_of")).agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in values])
    starts = starts.select("_of", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_first_{k}") for k in values])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    made = placed.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in values})
    made = made.join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    made = made.withColumns({f"before_{k}": F.col(f"_first_{k}") + F.col(f"_in_{k}") for k in values})
    return made.drop("_part", "_of", *[f"{p}_{k}" for k in values for p in ("", "_in", "_first")])


def meet(rows: DataFrame, key: Column, table: DataFrame, of: str, count: str, size: Column, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` left-joined to ``table`` where ``key`` equals its column ``of``, null as a value of its own.

    ``table`` has a row for each key, with the number of rows that have it
    (``count``) and columns whose names ``rows`` lacks; ``size`` says the bytes of such a row. A table of up to ``most_bytes``
    is broadcast. Beyond that only its rows for keys with over 1 / HOT_KEYS of all
    rows are, which are fewer than HOT_KEYS; the other rows meet theirs by a
    shuffled join, in which no key is large.
    """
    total = table.agg(F.sum(count).alias("n"), F.sum(size).alias("bytes")).first()
    table = table.withColumn("_met", F.lit(True))
    same = key.eqNullSafe(F.col(of))
    if (total["bytes"] or 0) <= most_bytes:
        return rows.join(F.broadcast(table), same, "left").drop("_met")
    large = F.col(count) > total["n"] / HOT_KEYS
    met = rows.join(F.broadcast(table.filter(large)), same, "left")
    apart = met.filter("_met is null").drop(*table.columns).join(table.filter(~large).hint("merge"), same, "left")
    return met.filter("_met").unionByName(apart).drop("_met")


def keep_rows(docs: DataFrame, made, keep) -> DataFrame:
    """The rows of ``docs`` for which ``keep`` of the Arrow values of column ``made`` is true; no shuffle, all columns stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))

    def run(batches):
        for b in batches:
            mask = pa.array(keep(b.column(b.num_columns - 1)), pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names).filter(mask)

    return docs.withColumns({"_made_for_keep_rows": made}).mapInArrow(tidy(run), kinds).toDF(*docs.columns)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES, rows: int = 1 << 30):
    """Row ranges of about ``most`` bytes and ``rows`` rows at most; a longer single row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (n + 1 entries)."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def tidy(run):
    """A batch function that hands memory back to the system when its task ends: workers are reused, and an executor's limit counts what idle ones hold."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return wrapped


def with_word_counts(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with the number of words of a text column (null: 0) as a long in its place, named ``name``."""
    rest = [c for c in rows.columns if c != text_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema.fields)

    def run(batches):
        for b in batches:
            data, off = flat(b.column(b.num_columns - 1))
            n = [np.diff(words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[2]) for lo, hi in blocks(off)]
            n = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*rest, name])

    return rows.select(*rest, text_col).mapInArrow(tidy(run), f"{kinds}, `{name}` long")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place where it can be."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Hasher:
    """Hashes of byte ranges and of word windows, by prefix sums.

    Polynomials modulo 2**64 with an odd base, which only sequences of some
    hundreds of symbols can defeat whatever the base (those of Thue and Morse); longer words and
    sequences are hashed whole by XXH64 instead.
    """

    LONG = 128

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.Generator(np.random.PCG64(seed))
        self.byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = [int(x) | 1 for x in rng.integers(0, 1 << 62, 2)]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[which][0]) < n:
            made = []
            for b in (self.base[which], pow(self.base[which], -1, 1 << 64)):
                x = np.full(n + n // 4 + 1, b, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.powers[which] = tuple(made)
        return self.powers[which]

    def _ranges(self, which: int, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(which, len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._ranges(0, self.byte[data], starts, ends)
        for k in np.flatnonzero(ends - starts > self.LONG).tolist():
            h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], self.seed)
        return h

    def sequences(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hash of each row's words, whose first ones ``first`` (n + 1 entries) tells."""
        n = np.diff(first)
        h = self.windows(hashes, first[:-1], n)
        for k in np.flatnonzero(n > self.LONG).tolist():
            h[k] = xxhash.xxh64_intdigest(hashes[first[k] : first[k + 1]], self.seed)
        return h

    def windows(self, hashes: np.ndarray, at: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` (a number or one per window) words from each of ``at``."""
        return self._ranges(1, hashes, at, at + length)


def labels_of(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links left-right."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable over ``links(a, b)``.

    Every node of a link comes back once. Large-star and small-star steps
    alternate until nothing moves; each step groups by map-side minima and joins
    them back, so a node with very many links is split by the skew-join rule and
    is never gathered. Each round is checkpointed.
    """
    edges = cut(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", "m"))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
