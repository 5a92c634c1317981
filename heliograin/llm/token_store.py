"""Operator 10: token ids in wavelet-matrix shards.

Texts are range-partitioned and sorted by id, encoded, and cut into shards of a
bounded number of tokens. A shard is one file: a header, the documents' ids and
ends, and a bit-plane for each bit of the vocabulary. Planes are cut into blocks
of ``BLOCK_BITS`` that are compressed one by one, with the number of ones
before each block as rank samples and a directory of where blocks lie. So a token, a
count or an occurrence is read by opening one or two blocks of each plane (``Shard``;
``token_at``, ``count_token`` and ``occurrences`` over all shards), not the whole
file. Files go through Spark's Parquet writer (a row is a file's
payload), so any store that Spark can write to holds them.

Defined results: a null text encodes as the empty text (its end id only);
documents without an id come first and read back without one; repeated ids are kept, ordered by text; an empty table gives no shard and an
empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"WVMX0003"
SHARD_TOKENS = 2 << 20
PARTITION_BYTES = 48 << 20
#: Distinct words that an encoder remembers before it forgets the rarer ones.
CACHE_WORDS = 400_000
#: Bits of a plane that are compressed together.
BLOCK_BITS = 1 << 16


def planes_of(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes of a sequence of ids, most significant first, each partitioned stably by the one before, and the zeros of each."""
    planes, zeros, now = [], [], ids
    for level in reversed(range(bits)):
        one = (now & now.dtype.type(1 << level)) != 0
        planes.append(np.packbits(one, bitorder="little"))
        low = now[~one]
        zeros.append(len(low))
        now = np.concatenate([low, now[one]])
    return planes, zeros


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int, unnamed: int = 0) -> bytes:
    """A shard's file: magic, counts, sizes of the parts, the parts, then the compressed blocks of all planes.

    The first ``unnamed`` documents have no id. Parts, each compressed: documents' ids, their ends, zeros of each plane, ones before each block, and where each block begins.
    """
    (planes, zeros), z = planes_of(ids, bits), zstandard.ZstdCompressor(level=1)
    step, ones, blocks = BLOCK_BITS // 8, [], []
    for plane in planes:
        cut = [plane[k : k + step] for k in range(0, len(plane), step)]
        counts = [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in cut]
        ones.append(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]))
        blocks += [z.compress(x.tobytes()) for x in cut]
    begins = np.cumsum([0, *map(len, blocks)])
    parts = [z.compress(np.asarray(x, "<i8").tobytes()) for x in (doc_ids, ends, zeros, np.concatenate(ones) if ones else [], begins)]
    return MAGIC + struct.pack("<QQQI5Q", len(doc_ids), unnamed, len(ids), bits, *map(len, parts)) + b"".join(parts) + b"".join(blocks)


class Shard:
    """One file: its documents, and rank, select, access and occurrences over compressed planes."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a shard of this format")
        head = struct.calcsize("<QQQI5Q")
        _, self.unnamed, self.n, self.bits, *sizes = struct.unpack_from("<QQQI5Q", payload, 8)
        self.z, parts, at = zstandard.ZstdDecompressor(), [], 8 + head
        for size in sizes:
            parts.append(np.frombuffer(self.z.decompress(payload[at : at + size]), "<i8"))
            at += size
        self.doc_ids, self.ends, self.zeros, ones, self.begins = parts
        self.payload, self.base = payload, at
        self.blocks = -(-self.n // BLOCK_BITS)
        self.ones = ones.reshape(self.bits, -1) if self.bits else ones
        self.opened = 0

    def names(self) -> pa.Array:
        """The documents' ids, null where there is none."""
        return pa.array(self.doc_ids, mask=np.arange(len(self.doc_ids)) < self.unnamed)

    def _block(self, k: int, j: int) -> np.ndarray:
        """The bits of one block of plane k."""
        at = k * self.blocks + j
        self.opened += 1
        raw = self.z.decompress(self.payload[self.base + self.begins[at] : self.base + self.begins[at + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")

    def _rank1(self, k: int, i: int) -> int:
        """Ones before position i of plane k."""
        j, rest = divmod(i, BLOCK_BITS)
        return int(self.ones[k, j]) + (int(self._block(k, j)[:rest].sum(dtype=np.int64)) if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            j, rest = divmod(i, BLOCK_BITS)
            block = self._block(k, j)
            one, r = int(block[rest]), int(self.ones[k, j]) + int(block[:rest].sum(dtype=np.int64))
            value = value << 1 | one
            i = int(self.zeros[k]) + r if one else i - r
        return value

    def _range(self, c: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of c before a position lie after the last plane."""
        lo, hi = 0, upto
        if c < 0 or c >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if c >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, c: int, upto: int) -> int:
        """Occurrences of c before a position."""
        lo, hi = self._range(c, upto)
        return hi - lo

    def count(self, c: int) -> int:
        return self.rank(c, self.n)

    def _selected(self, k: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Positions in plane k of the ``which``-th (from 0, ascending) ones or zeros."""
        before = self.ones[k] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self.ones[k]
        home = np.searchsorted(before, which, "right") - 1
        found = np.empty(len(which), np.int64)
        for j in np.unique(home).tolist():
            mine = home == j
            block = self._block(k, j)[: self.n - j * BLOCK_BITS]
            found[mine] = np.flatnonzero(block == bit)[which[mine] - before[j]] + j * BLOCK_BITS
        return found

    def occurrences(self, c: int) -> np.ndarray:
        """Positions of all occurrences of c, ascending."""
        lo, hi = self._range(c, self.n)
        at = np.arange(lo, hi)
        for k in reversed(range(self.bits)) if hi > lo else ():
            one = c >> (self.bits - 1 - k) & 1
            at = self._selected(k, one, at - int(self.zeros[k]) if one else at)
        return at

    def select(self, c: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of c."""
        lo, hi = self._range(c, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        at = np.array([lo + j])
        for k in reversed(range(self.bits)):
            one = c >> (self.bits - 1 - k) & 1
            at = self._selected(k, one, at - int(self.zeros[k]) if one else at)
        return int(at[0])

    def decode(self) -> np.ndarray:
        """All ids: the partitions undone from the last plane up."""
        kind = np.dtype(np.uint16 if self.bits <= 16 else np.uint32)
        now = np.zeros(self.n, kind)
        for k in reversed(range(self.bits)):
            one = np.concatenate([self._block(k, j) for j in range(self.blocks)] or [np.empty(0, np.uint8)])[: self.n].astype(bool)
            before = np.empty(self.n, kind)
            before[~one] = now[: int(self.zeros[k])]
            before[one] = now[int(self.zeros[k]) :] | kind.type(1 << (self.bits - 1 - k))
            now = before
        return now


# The rules under which words can be cut into pieces before the library's model.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pieces": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: Characters that normalisation only lower-cases, one by one: ASCII and Latin letters without U+0130.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+")


_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
# The byte-level alphabet by its rule: printable bytes stand for themselves, the others for the code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Encodes texts word by word with the library, each distinct word once.

    The tokenizer's own rules drop white space and never join across it, so the
    ids of a text are those of its words in turn (checked against whole-text
    encoding in the tests). Under the rules of ``_RULES`` a word of plain
    characters is cut into pieces first, and each distinct piece goes to the
    library's model once; every other word passes the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = rules.get("normalizer") == _RULES["normalizer"] and split[0].get("pattern") == {"Regex": _RULES["pieces"]}
        self.pieces_of = regex.compile(_RULES["pieces"]).findall if known else None
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.known, self.pieces = _Numbers(), {}
        self.sizes, self.pool, self.uses = np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget rare words, and all but the most frequent half of a full memory."""
        order = np.argsort(-self.uses, kind="stable")[: CACHE_WORDS // 2]
        kept = np.sort(order[self.uses[order] > 2])
        names, self.known = list(self.known), _Numbers()
        self.known.update((names[k], i) for i, k in enumerate(kept.tolist()))
        begins, n = np.cumsum(self.sizes) - self.sizes, self.sizes[kept]
        self.pool = self.pool[np.repeat(begins[kept] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.sizes, self.uses = n, self.uses[kept] // 2
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {}

    def _packed(self, ids) -> bytes:
        return array(np.dtype(self.kind).char, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The piece's ids as bytes: a list of numbers takes some four times the memory."""
        name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        self.pieces[piece] = ids = self._packed(t.id for t in self.model.tokenize(name))
        return ids

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        made = [b""] * len(fresh)
        rest, seen = [], self.pieces
        for i, raw in enumerate(fresh):
            word = raw.decode()
            if self.pieces_of is None or "<|" in word:
                rest.append((i, word))
                continue
            # letters and then marks, as most words are, are two pieces at most
            low = word.lower()
            core = low.rstrip(_MARKS)
            if core.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
                ids = seen[core] if core in seen else self._piece(core)
                if len(core) < len(low):
                    tail = low[len(core) :]
                    ids = ids + (seen[tail] if tail in seen else self._piece(tail))
                made[i] = ids
                continue
            if not _PLAIN.fullmatch(word):
                rest.append((i, word))
                continue
            made[i] = b"".join([seen[piece] if piece in seen else self._piece(piece) for piece in self.pieces_of(low)])
        for lo in range(0, len(rest), 2000):
            some = rest[lo : lo + 2000]
            got = self.tokenizer.encode([w for _, w in some], is_pretokenized=True, add_special_tokens=False)
            each = [[] for _ in some]
            for k, token in zip(got.word_ids, got.ids):
                each[k].append(token)
            for (i, _), ids in zip(some, each):
                made[i] = self._packed(ids)
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made)) // np.dtype(self.kind).itemsize])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), self.kind)])

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each closed by ``end``, and where each text's ids end."""
        if len(self.known) > CACHE_WORDS:
            self._shrink()
        split = [t.split() for t in texts]
        n_words = np.cumsum([0, *map(len, split)])
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, n_words[-1])
        if self.known.fresh:
            self._learn()
        self.uses = np.bincount(which, minlength=len(self.sizes)) + np.pad(self.uses, (0, len(self.sizes) - len(self.uses)))
        begins = np.cumsum(self.sizes) - self.sizes
        n = self.sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(begins[which] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[n_words[1:]]
        return np.insert(ids, ends, self.kind(end)), ends + np.arange(1, len(texts) + 1)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all texts, in ascending order of id, as shard files under ``path``.

    Rows: first (smallest id of the shard, null if it begins with a document without one), part (order among shards that begin
    with an equal id), n_tokens, payload (the file).
    """
    size = C.text_bytes(docs, text_col)
    parts = max(1, -(-size // PARTITION_BYTES))

    def run(batches):
        gc.disable()  # the encoder makes many small lists and no cycles
        encoder, held, tokens, part = WordEncoder(tokenizer), [], 0, 0

        def shard():
            nonlocal held, tokens, part
            ids, ends = np.concatenate([h[1] for h in held]), [0]
            for h in held:
                ends.append(h[2] + (ends[-1][-1] if len(ends) > 1 else 0))
            doc_ids = np.concatenate([h[0] for h in held])
            unnamed = sum(h[3] for h in held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([None if unnamed else int(doc_ids[0])], pa.int64()), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack(doc_ids, np.concatenate(ends[1:]), ids, encoder.bits, unnamed)], pa.binary())],
                ["first", "part", "n_tokens", "payload"],
            )
            held, tokens, part = [], 0, part + 1
            return out

        for b in batches:
            data, off = C.flat(b.column(1))
            none = b.column(0).is_null().to_numpy(zero_copy_only=False)
            names = b.column(0).fill_null(0).to_numpy()
            for lo, hi in C.blocks(off):
                raw, at = data[off[lo] : off[hi]].tobytes(), off[lo : hi + 1] - off[lo]
                ids, ends = encoder.encode([raw[a:z] for a, z in zip(at, at[1:])], end_id)
                if held and tokens + len(ids) > shard_tokens:
                    yield shard()
                held.append((names[lo:hi], ids, ends, int(none[lo:hi].sum())))
                tokens += len(ids)
        if held:
            yield shard()

    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
        .repartitionByRange(parts, F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "body")
        .mapInArrow(C.tidy(run), "first long, part int, n_tokens long, payload binary")
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .parquet(path)
    )


_SHARDS = "first long, part int, n_tokens long, payload binary"


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The shards under ``path`` with ``before``, the ids of all shards before each."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    starts = C.running(shards.select(F.col("first").alias("_first"), F.col("part").alias("_part_of"), F.col("n_tokens").alias("_n")), [F.col("_first").asc_nulls_first(), F.col("_part_of")], n=F.col("_n"))
    # a row of 40 bytes for each shard of up to SHARD_TOKENS ids
    starts = C.cut(starts.select("_first", "_part_of", F.col("before_n").alias("before")))
    starts = F.broadcast(starts) if starts.count() * 40 <= C.BROADCAST_BYTES else starts
    return shards.join(starts, F.col("first").eqNullSafe(F.col("_first")) & (F.col("part") == F.col("_part_of"))).select("before", "payload")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """One row (n): how often a token id stands in the shards under ``path``, read from rank samples."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Shard(x.as_buffer().to_pybytes()).count(token) for x in b.column(0)], pa.int64())], ["n"])

    shards = spark.read.schema(_SHARDS).parquet(path).select("payload")
    return shards.mapInArrow(C.tidy(run), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Rows (id, position, at): the documents that hold a token id, where among the document's ids, and where among all."""

    def run(batches):
        for b in batches:
            for before, payload in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(payload.as_buffer().to_pybytes())
                at = shard.occurrences(token)
                doc = np.searchsorted(shard.ends, at, "right")
                starts = np.concatenate([[0], shard.ends[:-1]])
                yield pa.RecordBatch.from_arrays([shard.names().take(pa.array(doc)), pa.array(at - starts[doc]), pa.array(at + before)], ["id", "position", "at"])

    return _with_starts(spark, path).mapInArrow(C.tidy(run), "id long, position long, at long")


def token_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """Rows (at, token): the ids at places among all, each read from one block of each plane."""
    wanted = sorted(set(positions))

    def run(batches):
        for b in batches:
            for before, payload in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(payload.as_buffer().to_pybytes())
                here = [x for x in wanted if before <= x < before + shard.n]
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array([shard.access(x - before) for x in here], pa.int64())], ["at", "token"])

    return _with_starts(spark, path).mapInArrow(C.tidy(run), "at long, token long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32), a row for each document of the shards under ``path``.

    ``start`` counts the ids of all documents before it; the crc is over the
    ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for b in batches:
            for before, payload in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(payload.as_buffer().to_pybytes())
                ids, starts = shard.decode().astype("<u4"), np.concatenate([[0], shard.ends[:-1]])
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts, shard.ends)]
                yield pa.RecordBatch.from_arrays(
                    [shard.names(), pa.array(starts + before), pa.array(shard.ends - starts), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"]
                )

    return _with_starts(spark, path).mapInArrow(C.tidy(run), "id long, start long, n_tokens long, ids_crc32 long")


def shard_path(spark: SparkSession) -> str:
    return f"{C.checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shard_path(spark)
    write_shards(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path).withColumnRenamed("id", "doc_id")
