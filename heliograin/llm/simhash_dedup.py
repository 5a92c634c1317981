"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the
radius differ by at most one bit in some segment. Fingerprints are indexed
under each segment with one bit wiped out (a wildcard); those that meet under
an equal variant are compared on all bits. The guarantee is the pigeonhole's,
so no pair within the radius is lost.

A segment is two pieces. If two fingerprints differ by one bit in it, one of its
pieces is equal, so rows are dealt by each piece in turn, and the wildcard variants of the
other piece are made and joined where the rows meet: two rows of a fingerprint
travel for a segment, not one for each variant. Segments are the pieces' halves of
thirds of the fingerprint, or, where so many fingerprints would meet by chance
that comparing them costs more than dealing, all pairs of ``radius + 1`` pieces;
both are complete. Groups of equal pieces beyond ``CHUNK`` rows are dealt out in pairs
of chunks; runs whose members are all linked are not compared further.

Near-duplicate texts (``keep_first``) take five-word shingles and a Jaccard
similarity of 0.8 or more: texts are first united by their word sequences, then
candidates come from longer fingerprints (``SEGMENTS`` segments of ``LENGTH`` bits, however
many texts there are: n texts meet by chance in about n * n / 2300 pairs; a pair at 0.8 differs in 15 % of the bits and
meets in some segment with a probability of about 0.95, at 0.85 of 0.99), and inside the
neighbourhoods that candidates form, shingle sets are compared exactly.

Defined results: a null or empty text has the fingerprint zero and links like
any other; equal texts share a fingerprint and so a component; repeated rows
(equal doc_id) are kept as they come; rows without an id take part, and a group of such rows only
has no component; an empty table gives an empty result;
further columns of the input are ignored whatever their names. ``keep_first``
keeps one row of each group, the one with the smallest id (nulls last; of equal
ids the one with the least text hash); texts without words are one group.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 64
#: Rows that a task compares at once; larger groups of equal pieces are dealt out in pairs of chunks.
CHUNK = 1 << 17
#: Bytes of texts that are hashed together.
BLOCK_BYTES = 512 << 10
#: Seconds to deal one row and to compare one pair: their ratio chooses the cut.
DEAL, COMPARE = 2e-6, 1e-8
#: The fingerprints of texts: segments, and bits of a segment.
SEGMENTS, LENGTH = 12, 18
SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold differs in this share of the bits, give or take; beyond it nothing is compared.
FARTHEST = 0.215
#: Members and bytes of shingle sets that a task compares with as many others.
SET_CHUNK, SET_BYTES = 512, 16 << 20
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)
_A, _B = C.Hasher(61), C.Hasher(62)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def majorities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint for each of ``len(first) - 1`` runs of hashes: the bits set in over half of them; zero for an empty run."""
    out, n = np.zeros(len(first) - 1, np.uint64), np.diff(first)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # eight 8-bit counters in a word: exact for up to 255 hashes at a time
    pieces = -(-n[full] // 255)
    begin = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(first[full] - begin * 255, pieces) + np.arange(pieces.sum()) * 255
    lanes = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        part = np.add.reduceat(_SPREAD[lanes[:, k]], cuts)
        counts = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        bits = np.packbits(counts * 2 > n[full, None], axis=1, bitorder="little")[:, 0]
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of one UTF-8 text, repeats included."""
    w, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not w:
        return []
    if len(w) <= shingle:
        return [digest(b" ".join(w), 42)]
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    joined = b" ".join(w)
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (id, fp long) for every row of ``docs``."""

    def run(batches):
        for b in batches:
            data, off = C.flat(b.column(1))
            raw, made = data.tobytes(), [np.empty(0, np.uint64)]
            for lo, hi in C.blocks(off, BLOCK_BYTES):
                found = [np.array(shingle_hashes(raw[off[i] : off[i + 1]], shingle), np.uint64) for i in range(lo, hi)]
                made.append(majorities(np.concatenate(found), np.cumsum([0, *map(len, found)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(made).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(C.tidy(run), "id long, fp long")


def cuts(n: int, radius: int, bits: int = BITS) -> tuple[list[int], list[tuple[int, int]]]:
    """Widths of the pieces of a fingerprint, and the (dealt, wiped) pieces that find all pairs within the radius among n.

    Of the two complete cuts the cheaper one is taken: segments of two pieces of
    which one differs by a bit at most, or all pairs of radius + 1 pieces, of
    which some pair does.
    """
    even = lambda k: [bits * (i + 1) // k - bits * i // k for i in range(k)]
    halves = 2 * (radius // 2 + 1)
    choices = [(even(halves), [(i, i ^ 1) for i in range(halves)]), (even(radius + 1), list(permutations(range(radius + 1), 2)))]
    choices = [c for c in choices if max(c[0]) <= 16]
    cost = lambda c: sum(DEAL + COMPARE * n * c[0][j] / 2.0 ** (c[0][i] + c[0][j] - 1) for i, j in c[1])
    return min(choices, key=cost)


def pieces_of(bits: np.ndarray, widths: list[int]) -> np.ndarray:
    """Fingerprints (rows of bits) as rows of 16-bit pieces, padded to whole 64-bit words."""
    out = np.zeros((len(bits), -(-len(widths) // 4) * 4), np.uint16)
    at = 0
    for k, w in enumerate(widths):
        out[:, k] = bits[:, at : at + w] @ (1 << np.arange(w)).astype(np.uint16)
        at += w
    return out


def _forest(gid: np.ndarray, value: np.ndarray, width: np.ndarray, words: np.ndarray, side: np.ndarray | None, radius: int) -> np.ndarray:
    """Labels of rows: of those within the radius that share a group and a variant of ``value``, the least index."""
    n = len(gid)
    label = np.arange(n)

    def merge(found):
        moved = np.flatnonzero(label != np.arange(n))
        left, right = zip(*found)
        return C.labels_of(np.concatenate([moved, *left]), np.concatenate([label[moved], *right]), n)

    for bit in range(int(width.max(initial=0))):
        rows = np.flatnonzero(width > bit)
        key = gid[rows].astype(np.uint64) << np.uint64(16) | (value[rows] & np.uint16(0xFFFF ^ 1 << bit)).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        at, step, found = np.arange(len(key)), 0, []
        while True:
            step += 1
            at = at[: np.searchsorted(at, len(key) - step)]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            i, j = rows[at], rows[at + step]
            apart = label[i] != label[j]
            if side is not None:
                apart &= side[i] != side[j]
            i, j = i[apart], j[apart]
            near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= radius
            if near.any():
                found.append((i[near], j[near]))
            if step & (step - 1) == 0:
                if found:
                    label, found = merge(found), []
                mine = label[rows]
                whole = np.minimum.reduceat(mine, starts) == np.maximum.reduceat(mine, starts)
                at = at[~whole[run[at]]]
        if found:
            label = merge(found)
    return label


def _linker(widths: list[int], routes: list[tuple[int, int]], radius: int, paired: bool):
    wiped = np.array([j for _, j in routes])
    wide = np.array([widths[j] for _, j in routes])

    def run(batches):
        held, rows = [], 0

        def work(t, whole):
            """All complete groups of a sorted table; the rest is carried on."""
            key = t.column("key").to_numpy()
            new = np.zeros(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            if paired:
                pair = t.column("pair").to_numpy()
                new[1:] |= pair[1:] != pair[:-1]
            gid = np.cumsum(new)
            last = len(key) if whole else int(np.searchsorted(gid, gid[-1]))
            if last:
                side = None
                if paired:
                    side, pair = t.column("chunk").to_numpy()[:last].copy(), pair[:last]
                    within = (pair >> 32) == (pair & 0xFFFFFFFF)
                    side[within] = np.arange(last)[within] + (1 << 40)  # in one chunk all compare
                raw = np.frombuffer(b"".join(t.column("print").slice(0, last).to_pylist()), np.uint16).reshape(last, -1)
                route = key[:last] >> 32
                label = _forest(gid[:last], raw[np.arange(last), wiped[route]], wide[route], raw.view(np.uint64), side, radius)
                node, moved = t.column("node").to_numpy(), np.flatnonzero(label != np.arange(last))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])
            return t.slice(last)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                rest = yield from work(pa.Table.from_batches(held).combine_chunks(), False)
                held, rows = rest.to_batches(), rest.num_rows
        if held and rows:
            yield from work(pa.Table.from_batches(held).combine_chunks(), True)

    return run


def links(prints: DataFrame, widths: list[int], routes: list[tuple[int, int]], radius: int) -> DataFrame:
    """Links (a, b) between nodes, keeping every component of the graph of all pairs that the routes find within the radius.

    ``prints`` has a row (node, print) for each fingerprint, with the bits of
    ``widths`` in little-endian order. A dense group of g members gives at most g links a task, not g squared.
    """
    bits = sum(widths)

    def dealt(batches):
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1)
            pieces = pieces_of(np.unpackbits(raw, axis=1, count=bits, bitorder="little"), widths)
            kept = pa.array([x.tobytes() for x in pieces], pa.binary())
            for r, (i, _) in enumerate(routes):
                yield pa.RecordBatch.from_arrays([pa.array((r << 32) + pieces[:, i].astype(np.int64)), b.column(0), kept], ["key", "node", "print"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    rows = prints.select("node", "print").mapInArrow(C.tidy(dealt), "key long, node long, print binary")
    # at most rows / CHUNK groups are large
    large = C.cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK))
    small = rows.join(F.broadcast(large), "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key")
    near = small.mapInArrow(C.tidy(_linker(widths, routes, radius, False)), "a long, b long")
    if not large.isEmpty():
        # each member goes to every pair of chunks that its own chunk is part of
        shared = (
            rows.join(F.broadcast(large), "key")
            .withColumn("chunks", F.ceil(F.col("n") / F.lit(CHUNK // 2)).cast("long"))
            .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            .select("key", "node", "print", "chunk", (F.shiftleft(F.least("chunk", "other"), 32) + F.greatest("chunk", "other")).alias("pair"))
            .repartition(parts, "key", "pair")
            .sortWithinPartitions("key", "pair")
        )
        near = near.union(shared.mapInArrow(C.tidy(_linker(widths, routes, radius, True)), "a long, b long"))
    return near.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Rows (id, fp, component): a row for each document, with the smallest id of its group."""
    prints = C.cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = C.cut(prints.groupBy("fp").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    little = F.unhex(F.concat(*[F.substring(F.lpad(F.hex("fp"), 16, "0"), 15 - 2 * k, 2) for k in range(8)]))
    widths, routes = cuts(distinct.count(), radius)
    groups = C.components(links(distinct.select("node", little.alias("print")), widths, routes, radius))
    named = distinct.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("first"))
    told = named.join(least, "component").select("fp", "first")
    return prints.join(told, "fp").select("id", "fp", F.col("first").alias("component"))


def text_cut(n: int | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """Pieces of the fingerprints of texts; the same for any number n of them, so that two texts meet or don't whatever stands beside them."""
    return [LENGTH // 2] * (2 * SEGMENTS), [(i, i ^ 1) for i in range(2 * SEGMENTS)]


def _shingles(texts, shingle: int = SHINGLE):
    """Of each block of rows: word hashes and first words, and each row's distinct shingle hashes."""
    data, off = C.flat(texts)
    data = _LOWER[data]
    for lo, hi in C.blocks(off, BLOCK_BYTES):
        part = data[off[lo] : off[hi]]
        starts, ends, first = C.words(part, off[lo : hi + 1] - off[lo])
        h = _A.words(part, starts, ends)
        n = np.diff(first)
        size = np.minimum(n, shingle)
        every = np.maximum(n - shingle + 1, np.minimum(n, 1))
        upto = np.cumsum(every)
        at = np.repeat(first[:-1] - (upto - every), every) + np.arange(upto[-1] if len(upto) else 0)
        s = _A.windows(h, at, np.repeat(size, every))
        yield lo, hi, (part, starts, ends, first), [np.unique(s[b - k : b]) for b, k in zip(upto, every)]


def _sketched(segments: int, length: int):
    """(id, text hash, text) to (id, hash, seq, n, print): the word sequence's hash, distinct shingles and their fingerprint."""
    bits = segments * length

    def run(batches):
        for b in batches:
            seqs, counts, prints = [], [], []
            for _, _, (part, starts, ends, first), sets in _shingles(b.column(2)):
                n = np.diff(first)
                pair = [f.sequences(f.words(part, starts, ends), first) for f in (_A, _B)]
                seqs += [x.tobytes() if k else b"" for x, k in zip(np.stack(pair, axis=1), n)]
                at = np.cumsum([0, *map(len, sets)])
                h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                words = [majorities(C.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), at) for k in range(-(-bits // 64))]
                prints += [x.tobytes() for x in np.stack(words, axis=1)]
                counts += np.diff(at).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seqs, pa.binary()), pa.array(counts, pa.int32()), pa.array(prints, pa.binary())], ["id", "hash", "seq", "n", "print"])

    return run


def jaccard_forest(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Labels of shingle sets: the least index reachable over pairs of at least ``threshold``, across sides only where given.

    Postings of all shingles say how many each set shares with all others; a set
    whose others are all in its own component is not counted again.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    label = np.arange(n)
    owner = np.repeat(np.arange(n), size)
    _, term = np.unique(np.concatenate(sets) if n else np.empty(0, np.uint64), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posting, upto = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term))]) if n else np.zeros(1, np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        open_ = label != label[i]
        if side is not None:
            open_ &= side != side[i]
        if not open_.any():
            continue
        mine = term[first[i] : first[i + 1]]
        k = upto[mine + 1] - upto[mine]
        at = np.repeat(upto[mine] - np.cumsum(k) + k, k) + np.arange(k.sum())
        both = np.bincount(posting[at], minlength=n)
        near = np.flatnonzero(open_ & (both >= threshold * (size + size[i] - both)))
        if len(near):
            joined = np.isin(label, [label[i], *label[near]])
            label[joined] = label[joined].min()
    return label


def _compared(threshold: float):
    """Links of blocks (component, pair) of sets, sorted by block; repeated nodes of a block count once."""

    def run(batches):
        held, rows = [], 0

        def work(t, whole):
            c, pair = t.column("component").to_numpy(), t.column("pair").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(c)]])
            cut = cut if whole else cut[:-1]
            for lo, hi in zip(cut, cut[1:]):
                node, at = np.unique(t.column("node").slice(lo, hi - lo).to_numpy(), return_index=True)
                raw = t.column("set").slice(lo, hi - lo).to_pylist()
                chunk = t.column("chunk").slice(lo, hi - lo).to_numpy()[at]
                side = None if pair[lo] >> 32 == pair[lo] & 0xFFFFFFFF else chunk
                label = jaccard_forest([np.frombuffer(raw[k], np.uint64) for k in at], threshold, side)
                moved = np.flatnonzero(label != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])
            return t.slice(int(cut[-1]))

        for b in batches:
            held.append(b)
            rows += b.nbytes
            if rows >= 4 * SET_BYTES:
                rest = yield from work(pa.Table.from_batches(held), False)
                held, rows = rest.to_batches(), rest.nbytes
        if held:
            yield from work(pa.Table.from_batches(held), True)

    return run


def _starred(threshold: float):
    """(component, node, set, hub) to (component, node, set, linked): whether a set reaches the threshold with its hub's."""

    def run(batches):
        for b in batches:
            linked = []
            for raw, hub in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(raw, np.uint64), np.frombuffer(hub, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(linked, pa.bool_())], ["component", "node", "set", "linked"])

    return run


def verified(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that keep the components of all pairs of at least ``threshold`` inside each neighbourhood of ``sets`` (component, node, set).

    A neighbourhood of more than ``SET_CHUNK`` sets or ``SET_BYTES`` is first compared with one of its
    sets, the hub. Those alike to it are one component already, so only the
    others are compared with all, in pairs of chunks.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.count("*") / SET_CHUNK, F.sum(F.octet_length("set")) / SET_BYTES)
    sizes = C.cut(sets.groupBy("component").agg(size.alias("chunks"), F.min("node").alias("hub")))
    columns = ["component", "pair", "chunk", "node", "set"]
    whole = sets.join(sizes.filter("chunks <= 1"), "component").withColumns({"pair": F.lit(0).cast("long"), "chunk": F.lit(0).cast("long")}).select(columns)
    star = None
    if not sizes.filter("chunks > 1").isEmpty():
        large = sets.join(sizes.filter("chunks > 1"), "component")
        hubs = large.filter("node = hub").select("component", F.col("set").alias("hub_set")).dropDuplicates(["component"])
        met = large.select("component", "node", "set").join(hubs, "component")
        met = C.cut(met.mapInArrow(C.tidy(_starred(threshold)), "component long, node long, set binary, linked boolean"))
        star = met.filter("linked").join(sizes, "component").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        split = met.groupBy("component").agg(*[F.ceil(F.greatest(F.count_if(F.col("linked") == on) / SET_CHUNK, F.sum(F.when(F.col("linked") == on, F.octet_length("set"))) / SET_BYTES)).cast("long").alias(k) for on, k in ((True, "near"), (False, "far"))])
        # chunks 0 .. far - 1 hold the others, the rest those alike to the hub; a pair has one of the others at least
        dealt = met.join(split.filter("far > 0"), "component")
        spread = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("near")).otherwise(F.col("far")))
        dealt = dealt.withColumn("chunk", F.when(F.col("linked"), F.col("far") + spread).otherwise(spread))
        upto = F.when(F.col("linked"), F.col("far")).otherwise(F.col("far") + F.coalesce("near", F.lit(0)))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
        dealt = dealt.withColumn("pair", F.shiftleft(F.least("chunk", "other"), 32) + F.greatest("chunk", "other")).select(columns)
        # a block's own number tells it from those of neighbourhoods compared whole
        whole = whole.union(dealt)
    blocks = whole.repartition(parts, "component", "pair").sortWithinPartitions("component", "pair", "chunk")
    found = blocks.mapInArrow(C.tidy(_compared(threshold)), "a long, b long")
    return found if star is None else found.union(star)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of near-duplicate texts, with the columns of ``docs``.

    Rows are told apart by id and text hash; of rows equal in both, the one of the least hash of all columns stays.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("body"))
    kind = named.schema["id"].dataType.simpleString()
    widths, routes = text_cut()
    rows = named.mapInArrow(C.tidy(_sketched(SEGMENTS, 2 * widths[0])), f"id {kind}, hash long, seq binary, n int, print binary")
    # rows of one word sequence are one node, stood for by its first row
    rows = rows.groupBy("seq", "id", "hash").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("print").alias("print"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "copies")
    nodes = C.cut(rows.groupBy("seq").agg(F.min(first).alias("rep"), F.first("n").alias("n"), F.first("print").alias("print")).withColumn("node", F.monotonically_increasing_id()))
    found = links(nodes.filter("n > 0").select("node", "print"), widths, routes, int(FARTHEST * sum(widths)))
    around = C.components(found)
    members = C.cut(nodes.join(around, "node").select("node", "component", F.col("rep.id").alias("_id"), F.col("rep.hash").alias("_hash")))

    def set_of(batches):
        for b in batches:
            made = [s.tobytes() for *_, sets in _shingles(b.column(2)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["component", "node", "set"])

    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    sets = named.join(members, same).select("component", "node", "body").mapInArrow(C.tidy(set_of), "component long, node long, set binary")
    groups = C.components(verified(C.cut(sets), threshold))
    told = nodes.select("node", "rep").join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("rep").alias("rep"))
    kept = C.cut(told.select(F.col("rep.id").alias("_id"), F.col("rep.hash").alias("_hash"), F.col("rep.copies").alias("_copies")))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    met = docs.join(kept, same)
    out = met.filter("_copies = 1").select(docs.columns)
    if not kept.filter("_copies > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        many = met.filter("_copies > 1").groupBy("_id", "_hash").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
        out = out.union(many.select("row.*"))
    return out


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
