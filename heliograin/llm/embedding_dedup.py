"""Operator 3: near-duplicate vectors by sorted projection passes.

In each pass all vectors, less the mean of their group (label and dimension), are ordered by their
group and by 64 concatenated sign hashes of random projections, and every vector is
compared with its next ``window`` neighbours. Without the mean the vectors of a crowded
label, which all point one way, would agree in most signs. Pairs that reach a threshold a
little below the asked one are united across passes into neighbourhoods. A
window bounds what one pass sees of a crowded place, so inside a neighbourhood
all vectors are then compared by blocks of matrix products in double precision,
which gives each vector's exact number of links there and the links that join
components. A pair is thus missed only if it meets in no pass and shares no
neighbourhood. Passes run in rounds until a round unites hardly anything that
those before did not (``GAIN`` of what they united): how many are run follows from the vectors, and
from how many of them crowd a label.

Equal vectors are one node with a multiplicity throughout. A neighbourhood
larger than a chunk is dealt out in pairs of chunks, a task holds two chunks at
most, and a chunk pair sends counts and at most one link for each member, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing (0 links, their own
component); vectors of different lengths never link; rows of equal id count as
separate vectors of one id; an empty table gives an empty result; further
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.98
#: Passes of the first round and of each later one, and neighbours that each vector meets in a pass.
PASSES, MORE_PASSES, WINDOW = 12, 6, 64
#: A round that adds no more than this share of all unions is the last.
GAIN = 1e-3
#: Groups whose sums a task holds before it sends them on.
HELD_GROUPS = 2000
#: How far below the threshold a pair may lie to join a neighbourhood.
MARGIN = 0.02
CHUNK = 1024


def _units(batches):
    """(id, digest, dim, label, unit): the unit vector's bytes, null where it can't link."""
    for b in batches:
        emb, label = b.column(2), b.column(1)
        values = emb.values.to_numpy(zero_copy_only=False)
        off, valid = np.asarray(emb.offsets), emb.is_valid().to_numpy(False) & label.is_valid().to_numpy(False)
        names = label.to_pylist()
        units, digests, dims = [None] * len(emb), [None] * len(emb), [0] * len(emb)
        for i in np.flatnonzero(valid):
            v = np.asarray(values[off[i] : off[i + 1]], np.float64)
            top = np.abs(v).max() if len(v) else 0.0
            if not 0 < top < np.inf:
                continue
            v = v / top
            raw = (v / np.sqrt(v @ v) + 0.0).tobytes()
            units[i], dims[i] = raw, len(v)
            digests[i] = hashlib.blake2b(str(names[i]).encode() + b"\0" + raw, digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), label, pa.array(units, pa.binary())], ["id", "digest", "dim", "label", "unit"]
        )


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of equal length from a binary column."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _summed(batches):
    """Sums of unit vectors by group: (label, dim, n, total)."""
    held: dict = {}

    def rows():
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())],
            ["label", "dim", "n", "total"],
        )

    for b in batches:
        labels, dims = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
        for key in set(zip(labels.tolist(), dims.tolist())):
            x = _matrix(b.column(2).take(pa.array(np.flatnonzero((labels == key[0]) & (dims == key[1])))))
            n, total = held.get(key, (0, 0.0))
            held[key] = (n + len(x), total + x.sum(axis=0))
        if len(held) > HELD_GROUPS:
            yield rows()
            held = {}
    if held:
        yield rows()


def _mean(t: pa.Table) -> pa.Table:
    n = sum(t.column("n").to_pylist())
    mean = _matrix(t.column("total").combine_chunks()).sum(axis=0) / n
    return pa.table({"label": [t.column("label")[0]], "dim": [t.column("dim")[0]], "n": [n], "mean": [mean.tobytes()]}, schema=_MEAN)


_MEAN = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("mean", pa.binary())])


def means(nodes: DataFrame) -> DataFrame:
    """Rows (of, n, mean): the mean unit vector of each group; ``of`` names the group."""
    part = nodes.select("label", "dim", "unit").mapInArrow(C.tidy(_summed), "label string, dim int, n long, total binary")
    made = part.groupBy("label", "dim").applyInArrow(lambda t: _mean(t), "label string, dim int, n long, mean binary")
    return made.select(F.struct("label", "dim").alias("of"), "n", "mean")


def _projected(first: int, passes: int, seed: int):
    """(node, label, dim, unit, mean) to a row for each pass, with the sign hashes of the vector less the mean."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, d, first])).standard_normal((d, 64 * passes))
                for lo in range(0, len(at), 2048):
                    rows = b.take(pa.array(at[lo : lo + 2048]))
                    x = _matrix(rows.column(3))
                    bits = np.packbits((x - _matrix(rows.column(4))) @ planes[d] > 0, axis=1).reshape(len(x), passes, 8)
                    keys = bits.view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                    small = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(x), p, np.int32)), rows.column(1), rows.column(2), pa.array(keys[:, p].view(np.int64)), rows.column(0), small],
                            ["pass", "label", "dim", "key", "node", "unit"],
                        )

    return run


def _neighbours(window: int, least: float):
    """Links of each sorted run's vectors with their next ``window`` neighbours, as a forest."""

    def run(batches):
        held, rows = [], 0

        def work(t):
            dims = t.column("dim").to_numpy()
            group = np.stack([t.column("pass").to_numpy(), dims, t.column("place").to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [len(dims)]])
            nodes, left, right = t.column("node").to_numpy(), [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                x = _matrix(t.column("unit").slice(lo, hi - lo).combine_chunks(), np.float32)
                for step in range(1, min(window, hi - lo - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= least) + lo
                    left.append(near)
                    right.append(near + step)
            left = np.concatenate(left) if left else np.empty(0, np.int64)
            right = np.concatenate(right) if right else np.empty(0, np.int64)
            names, where = np.unique(nodes, return_inverse=True)
            label = C.labels_of(where[left], where[right], len(names))
            moved = np.flatnonzero(label != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["a", "b"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 16_384 + window:
                t = pa.Table.from_batches(held)
                yield work(t)
                held, rows = t.slice(rows - window).to_batches(), window
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _blocks(threshold: float):
    """Counts (node, n, null) and links (node, null, other) of chunk pairs; rows come sorted by block."""

    def run(batches):
        held, rows = [], 0

        def one(nodes, chunk, m, x):
            first = chunk == chunk[0]
            if first.all():
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                n = near.astype(np.int64) @ m
                left, right = np.nonzero(np.triu(near))
            else:
                a, b = np.flatnonzero(first), np.flatnonzero(~first)
                near = x[a] @ x[b].T >= threshold
                n = np.zeros(len(nodes), np.int64)
                n[a], n[b] = near.astype(np.int64) @ m[b], near.T.astype(np.int64) @ m[a]
                i, j = np.nonzero(near)
                left, right = a[i], b[j]
            label = C.labels_of(left, right, len(nodes))
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes, n, nodes[moved], nodes[label[moved]]

        def work(t, whole):
            c = t.column("component").to_numpy()
            pair = t.column("pair").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(c)]])
            if not whole:
                cuts = cuts[:-1]
            nodes, chunk, m = (t.column(k).to_numpy() for k in ("node", "chunk", "m"))
            unit = t.column("unit").combine_chunks()
            found = [one(nodes[lo:hi], chunk[lo:hi], m[lo:hi], _matrix(unit.slice(lo, hi - lo))) for lo, hi in zip(cuts, cuts[1:])]
            if found:
                nodes, n, a, b = map(np.concatenate, zip(*found))
                # within a pair of different chunks, members of one chunk are not counted
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes, a])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])), pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(b, pa.int64())])],
                    ["node", "n", "other"],
                )
            return t.slice(int(cuts[-1]))

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 8 * CHUNK:
                rest = yield from work(pa.Table.from_batches(held), False)
                held, rows = rest.to_batches(), rest.num_rows
        if held:
            yield from work(pa.Table.from_batches(held), True)

    return run


def neighbourhoods(nodes: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW, seed: int = 3) -> DataFrame:
    """Rows (node, component): the nodes that passes unite, of ``nodes`` (node, label, dim, unit)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mean = C.cut(means(nodes))
    centred = C.meet(nodes.select("node", "label", "dim", "unit"), F.struct("label", "dim"), mean, "of", "n", F.octet_length("mean") + 64)
    centred = centred.select("node", "label", "dim", "unit", "mean")
    sort = ["pass", "label", "dim", "key", "node"]
    found = around = None
    while True:
        first = 0 if found is None else first + passes
        passes = passes if found is None else MORE_PASSES
        near = (
            centred.mapInArrow(C.tidy(_projected(first, passes, seed)), "pass int, label string, dim int, key long, node long, unit binary")
            .repartitionByRange(parts, *sort)
            .sortWithinPartitions(*sort)
            .select("pass", F.xxhash64("label").alias("place"), "dim", "node", "unit")
            .mapInArrow(C.tidy(_neighbours(window, threshold - MARGIN)), "a long, b long")
        )
        near = C.cut(near.distinct())
        if found is None:
            found = near
        else:
            sides = [around.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"]
            fresh = near.join(sides[0], "a", "left").join(sides[1], "b", "left")
            fresh = C.cut(fresh.filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"))
            if fresh.count() <= GAIN * found.count():
                return around
            found = found.union(fresh)
        around = C.cut(C.components(found))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, seed: int = 3
) -> DataFrame:
    """Rows (id, n_links, component), a row for each row of ``vectors``."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = C.cut(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
            C.tidy(_units), "id long, digest binary, dim int, label string, unit binary"
        )
    )
    nodes = C.cut(
        base.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    around = neighbourhoods(nodes, threshold, passes, window, seed)
    sizes = around.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    dealt = (
        nodes.select("node", "m", "unit")
        .join(around, "node")
        .join(sizes, "component")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("component", (F.shiftleft(F.least("chunk", "other"), 32) + F.greatest("chunk", "other")).alias("pair"), "chunk", "node", "m", "unit")
        .repartition(parts, "component", "pair")
        .sortWithinPartitions("component", "pair", "chunk")
    )
    found = C.cut(dealt.mapInArrow(C.tidy(_blocks(threshold)), "node long, n long, other long"))
    links = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    groups = C.cut(C.components(links))
    named = nodes.select("node", "rep", "m", "digest").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("first"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    told = named.join(least, "component").join(counts, "node", "left").select("digest", "first", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    linked = base.select("id", "digest").filter("digest is not null").join(told, "digest").select("id", "n_links", F.coalesce("first", "id").alias("component"))
    alone = base.filter("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(C.table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reached GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
