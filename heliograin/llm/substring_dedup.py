"""Operator 2: removal of repeated word windows by level-wise doubling.

Levels are window lengths, each at most twice the one before, ending at the
asked window. At a level every window that is still a candidate is stood for by
one of its sub-windows of the level's length (the one with the least hash, the
leftmost of equals), which is the same sub-window wherever the same words
stand. Only windows whose stand-in occurs more than once go on to the next
level; at the last level the stand-in is the window itself.

Documents are dealt by id and text into groups of bounded bytes. A group sends each distinct
key of a level once, with a mark if it holds it twice itself, so a passage that
millions of documents share reaches a task at most once from each group.
Keys are 64-bit hashes below the last level, where a clash only lets a
candidate through, and 128-bit hashes at the last.

Defined results: a null or empty text has no words (0, 0, the empty string);
texts shorter than the window lose nothing; equal rows repeat each other;
an empty table gives an empty result; further columns are ignored whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 35
GROUP_BYTES = 4 << 20
_A, _B = C.Hasher(11), C.Hasher(12)


def levels(window: int, first: int) -> list[int]:
    """Doubling lengths from ``first`` that end at ``window``."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each run of ``width`` values."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at, have = np.where(h[b] < h[a], b, a), have + step
    return at


class _Group:
    """Hashes of one group of texts; candidates narrow level by level."""

    def __init__(self, texts: pa.ChunkedArray, window: int):
        self.data, self.offsets = C.flat(texts)
        self.window = window
        a, b, first, self.starts, self.ends = [], [], [0], [], []
        for lo, hi in C.blocks(self.offsets):
            base = self.offsets[lo]
            data = self.data[base : self.offsets[hi]]
            s, e, begin = C.words(data, self.offsets[lo : hi + 1] - base)
            a.append(_A.words(data, s, e))
            b.append(_B.words(data, s, e))
            first.extend((begin[1:] + first[-1]).tolist())
            self.starts.append(s + base)
            self.ends.append(e + base)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.a, self.b = cat(a, np.uint64), cat(b, np.uint64)
        self.starts, self.ends, self.first = cat(self.starts, np.int64), cat(self.ends, np.int64), np.array(first)
        n = np.diff(self.first)
        fits = np.maximum(n - window + 1, 0)
        # each window's first word, over all texts of the group
        self.at = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(fits)[:-1]]), fits) + np.arange(fits.sum())

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the candidates' stand-ins and, for each candidate, the index of its own."""
        if length == self.window:
            two = np.empty(len(self.at), dtype=[("a", "<u8"), ("b", "<u8")])
            two["a"], two["b"] = _A.windows(self.a, self.at, length), _B.windows(self.b, self.at, length)
            order = np.lexsort((two["b"], two["a"]))
            ranked = two[order]
            new = np.ones(len(two), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            own = np.empty(len(two), np.int64)
            own[order] = np.cumsum(new) - 1
            return ranked[new], own
        if not len(self.at):
            self.places = self.of_place = np.empty(0, np.int64)
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = _A.windows(self.a, np.arange(len(self.a) - length + 1), length)
        stand = _leftmost_least(h, self.window - length + 1)[self.at]
        self.places, place = np.unique(stand, return_inverse=True)
        keys, own = np.unique(h[self.places], return_inverse=True)
        self.of_place = own
        return keys, own[place]

    def twice(self, length: int, n: int, own: np.ndarray) -> np.ndarray:
        """Marks the keys that stand at two places of this group."""
        return np.bincount(own if length == self.window else self.of_place, minlength=n) > 1

    def narrow(self, length: int, repeated: np.ndarray) -> None:
        """Keep the candidates whose key is repeated here or, as other groups say, elsewhere."""
        keys, own = self.keys(length)
        keep = self.twice(length, len(keys), own)
        if len(repeated):
            keep |= np.isin(keys if length < self.window else keys["a"], repeated)
        self.at = self.at[keep[own]]


def _emit(group: _Group, g: int, length: int, buckets: int) -> pa.Table:
    keys, own = group.keys(length)
    twice = group.twice(length, len(keys), own)
    lead = keys if length < group.window else keys["a"]
    bucket = (lead >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(int(i), keys[order[a:b]].tobytes(), np.packbits(twice[order[a:b]]).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pa.table(
        {"bucket": [r[0] for r in rows], "g": [g] * len(rows), "keys": [r[1] for r in rows], "twice": [r[2] for r in rows]},
        schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())]),
    )


_FOUND = pa.schema([("g", pa.int32()), ("level", pa.int32()), ("repeated", pa.binary())])


def _repeated(t: pa.Table, level: int, wide: bool) -> pa.Table:
    """For each group, those of its keys in this bucket that stand in another group or twice in one."""
    kind = np.dtype([("a", "<u8"), ("b", "<u8")]) if wide else np.dtype("<u8")
    parts = [np.frombuffer(x, kind) for x in t.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(t.column("twice").to_pylist(), parts)]
    twice = np.concatenate(marks).astype(bool)
    order = np.lexsort((keys["b"], keys["a"])) if wide else np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    run = np.cumsum(new) - 1
    many = (np.bincount(run) > 1) | (np.bincount(run, weights=twice[order]) > 0)
    hit = np.empty(len(keys), bool)
    hit[order] = many[run]
    rows, groups = [], t.column("g").to_pylist()
    lead = keys["a"] if wide else keys
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for i, g in enumerate(groups):
        mine = lead[cuts[i] : cuts[i + 1]][hit[cuts[i] : cuts[i + 1]]]
        if len(mine):
            rows.append((g, mine.tobytes()))
    return pa.table({"g": [r[0] for r in rows], "level": [level] * len(rows), "repeated": [r[1] for r in rows]}, schema=_FOUND)


def _narrowed(docs: pa.Table, found: pa.Table | None, window: int, upto: list[int]) -> _Group:
    group = _Group(docs.column("body"), window)
    for i, length in enumerate(upto):
        blobs = [x for x, lv in zip(found.column("repeated").to_pylist(), found.column("level").to_pylist()) if lv == i]
        group.narrow(length, np.concatenate([np.frombuffer(x, "<u8") for x in blobs]) if blobs else np.empty(0, np.uint64))
    return group


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = 18) -> DataFrame:
    """Rows (id, n_words, n_removed, kept, spans): texts without the words of repeated windows.

    ``kept`` holds the kept words joined by one space; ``spans`` the removed word
    ranges (start, end) as positions in the input, end exclusive.
    """
    size = C.text_bytes(docs, text_col)
    groups = max(1, -(-size // GROUP_BYTES))
    lengths = levels(window, first)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).cast("int").alias("g"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("body"),
    )

    def emitted(i: int, found: DataFrame | None) -> DataFrame:
        def alone(key, t):
            return _emit(_narrowed(t, None, window, []), key[0].as_py(), lengths[i], groups)

        def narrowed(key, t, f):
            return _emit(_narrowed(t, f, window, lengths[:i]), key[0].as_py(), lengths[i], groups)

        by, schema = dealt.groupBy("g"), "bucket int, g int, keys binary, twice binary"
        return by.applyInArrow(alone, schema) if found is None else by.cogroup(found.groupBy("g")).applyInArrow(narrowed, schema)

    def counted(i: int, keys: DataFrame) -> DataFrame:
        def repeated(t):
            return _repeated(t, i, lengths[i] == window)

        return keys.groupBy("bucket").applyInArrow(repeated, "g int, level int, repeated binary")

    found = None
    for i in range(len(lengths)):
        now = counted(i, emitted(i, found))
        found = now if found is None else found.union(now)

    def finish(key, t, f):
        group = _narrowed(t, f, window, lengths)
        gone = np.zeros(len(group.starts) + 1, np.int64)
        np.add.at(gone, group.at, 1)
        np.add.at(gone, group.at + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        n, kept, spans, removed = np.diff(group.first), [], [], []
        raw = group.data.tobytes()
        for i in range(len(n)):
            a, b = int(group.first[i]), int(group.first[i + 1])
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).reshape(-1, 2)
            removed.append(int(g.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge])
            at, out = 0, []
            for x, y in [*edge.tolist(), (b - a, b - a)]:
                if x > at:
                    out.append(b" ".join(raw[group.starts[a + at] : group.ends[a + x - 1]].split()))
                at = y
            kept.append(b" ".join(out))
        return pa.table(
            [t.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["id", "n_words", "n_removed", "kept", "spans"],
        )

    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(
        finish, "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY k) AS n
  FROM (SELECT r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d))
), gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM windows WHERE n > 1)
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r
), removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""
