"""Operator 9: shards of equal bytes by a k-d tree over document metadata.

Rows of equal texts are one unit, with the least source and language among
them. The tree starts with all units and the number of shards. A node that
stands for several shards is split along its widest metadata dimension (rank of
the source and of the language in code point order, logarithm of the text's
size, each scaled to 0..1 over the corpus), at the weighted median: the cut that
is nearest to each side's share of the shards' room. Inside an equal value, texts stand
in the order of a hash, so that a value that holds a third of all bytes can be cut too.

The tree is built over cells, not documents: a cell is a value of each dimension
(ranks of more than ``RANKS`` values are grouped) and, where it holds more than
a small part of a shard, a range of text hashes. Cells are bounded in number
whatever the corpus, and a level of the tree is one window over them: running
bytes by node along the node's widest dimension. All levels are one plan, without a
step on the driver.

Texts that hold more than 1 / GRAINS of a shard (in bytes or in rows; at most 2 * GRAINS
of them a shard) are placed before the tree, the largest first, each whole in
the shard with the most room left; the tree shares out the remaining room. Only
a text that fits in no shard is cut, its rows take part in the tree one by one
by a hash of their ids. So equal texts share a shard unless they overfill it.

Only DataFrame functions are used. The metadata table (no texts) is written
once, in the checkpoint folder all executors share.

Defined results: a null or empty text has size 16 and the checksum of the empty
string; null metadata form a value of their own, at the low end; repeated rows
are separate rows of one unit; equal ids need not share a shard; an empty table
gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARDS = 40
ROW_BYTES = 16
GRAINS = 50
#: Groups of the ranks of source and language, and parts of a doubling of the size, that cells tell apart.
RANKS, SIZE_STEPS = (1024, 64), 4
SLOT_GROUPS = 64


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Rows (id, size, text_crc32, text_hash, source, lang), written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return C.cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.col(source_col).cast("string").alias("source"),
            F.col(lang_col).cast("string").alias("lang"),
        )
    )


def ranked(meta: DataFrame) -> DataFrame:
    """``meta`` with the cell coordinates q0, q1 (groups of source and language ranks) and q2 (steps of the size)."""
    both = F.array(F.struct(F.lit(0).alias("d"), F.col("source").alias("value")), F.struct(F.lit(1).alias("d"), F.col("lang").alias("value")))
    values = meta.select(F.explode(both).alias("v")).groupBy("v.d", "v.value").agg(F.count("*").alias("n_rows"))
    values = C.running(values, [F.col("d"), F.col("value").asc_nulls_first()], rank=F.lit(1))
    ends = values.groupBy("d").agg(F.min("before_rank").alias("first"), F.count("*").alias("n_values"))
    most = F.when(F.col("d") == 0, RANKS[0]).otherwise(RANKS[1])
    rank = F.col("before_rank") - F.col("first")
    place = F.when(F.col("n_values") <= most, rank).otherwise(F.floor(rank * most / F.col("n_values"))).cast("int")
    values = values.join(F.broadcast(ends), "d").select("d", "value", "n_rows", place.alias("place"))
    found = meta
    for k, name in enumerate(("source", "lang")):
        one = values.filter(F.col("d") == k).select(F.col("value").alias("of"), "n_rows", F.col("place").alias(f"q{k}"))
        found = C.meet(found, F.col(name), one, "of", "n_rows", F.coalesce(F.octet_length("of"), F.lit(0)) + 32).drop("of", "n_rows")
    return found.withColumn("q2", F.floor(F.log2(F.col("size").cast("double")) * SIZE_STEPS).cast("int"))


def fit(texts: list[tuple[int, int, int]], room: list[float]) -> dict[int, int]:
    """Shards of texts (name, bytes, rows), the largest first in the shard with the most room; -1 for those to be cut.

    ``room`` is lessened by what is placed.
    """
    heap = [(-r, k) for k, r in enumerate(room)]
    heapq.heapify(heap)
    placed = {}
    for name, size, n in sorted(texts, key=lambda t: (-t[1], t[0])):
        if n > 1 and size > -heap[0][0]:
            placed[name] = -1
            continue
        k = heap[0][1]
        room[k] -= size
        heapq.heapreplace(heap, (-room[k], k))
        placed[name] = k
    return placed


def tree(cells: DataFrame, room: list[float]) -> DataFrame:
    """``cells`` (q0, q1, q2, tie, bytes) with their shard: all levels of the tree as windows over nodes.

    A node is named by its first shard and its number of shards.
    """
    upto = [0.0]
    for r in room:
        upto.append(upto[-1] + max(r, 0.0))
    before = F.from_json(F.lit(json.dumps(upto)), "array<double>")
    spans = cells.agg(*[f(f"q{k}").alias(f"{n}{k}") for k in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = [max((spans[f"hi{k}"] or 0) - (spans[f"lo{k}"] or 0), 1) for k in range(3)]
    placed = cells.withColumns({"node": F.lit(0), "wide": F.lit(len(room))})
    for _ in range(math.ceil(math.log2(max(len(room), 1)))):
        whole = W.partitionBy("node", "wide")
        placed = placed.withColumns({f"r{k}": (F.max(f"q{k}").over(whole) - F.min(f"q{k}").over(whole)) / F.lit(float(scale[k])) for k in range(3)})
        widest = F.greatest("r0", "r1", "r2")
        along = F.when(F.col("r0") == widest, F.col("q0")).when(F.col("r1") == widest, F.col("q1")).otherwise(F.col("q2"))
        placed = placed.withColumn("along", along)
        order = whole.orderBy("along", "tie", "q0", "q1", "q2").rowsBetween(W.unboundedPreceding, 0)
        placed = placed.withColumns({"upto": F.sum("bytes").over(order), "all": F.sum("bytes").over(whole)})
        left = F.floor(F.col("wide") / 2).cast("int")
        at = lambda n: F.get(before, n)
        mine, theirs = at(F.col("node") + left) - at(F.col("node")), at(F.col("node") + F.col("wide")) - at(F.col("node"))
        share = F.when(theirs > 0, mine / theirs).otherwise(0.5)
        right = (F.col("wide") > 1) & (F.col("upto") - F.col("bytes") / 2 > share * F.col("all"))
        placed = placed.withColumns(
            {
                "node": F.when(right, F.col("node") + left).otherwise(F.col("node")),
                "wide": F.when(right, F.col("wide") - left).when(F.col("wide") > 1, left).otherwise(F.col("wide")),
            }
        ).select("q0", "q1", "q2", "tie", "bytes", "node", "wide")
    return placed.select("q0", "q1", "q2", "tie", F.col("node").alias("shard"))


def shards(meta: DataFrame, count: int = SHARDS) -> DataFrame:
    """Rows (id, size, text_crc32, shard) of ``meta``, with shards from 0 to ``count`` - 1."""
    spark = meta.sparkSession
    totals = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    grain, grain_rows = totals["bytes"] / (count * GRAINS), totals["n"] / (count * GRAINS)
    texts = meta.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > grain) | (F.col("n") > grain_rows) & (F.col("n") > 1))
    room = [totals["bytes"] / count] * count
    # at most 2 * GRAINS * count texts
    placed = fit([tuple(r) for r in texts.collect()], room)
    entries = json.dumps([{"h": h, "to": k} for h, k in placed.items()])
    large = spark.range(1).select(F.explode(F.from_json(F.lit(entries), "array<struct<h:bigint,to:int>>")).alias("x")).select(F.col("x.h").alias("_h"), F.col("x.to").alias("_to"))
    rows = ranked(meta).join(F.broadcast(large), F.col("text_hash") == F.col("_h"), "left")
    done = rows.filter("_to >= 0").select("id", "size", "text_crc32", F.col("_to").alias("shard"))
    alone = rows.filter("_to = -1").withColumn("tie", F.xxhash64(F.lit(9), "id", "text_hash"))
    same = W.partitionBy("text_hash")
    whole = rows.filter("_to is null").withColumns({"q0": F.min("q0").over(same), "q1": F.min("q1").over(same), "tie": F.col("text_hash")})
    columns = ["id", "size", "text_crc32", "q0", "q1", "q2", "tie"]
    rest = alone.select(columns).union(whole.select(columns))
    # cells of over 1 / 4 of a grain, at most 4 * GRAINS * count of them, are cut by the leading bits of the tie
    heavy = rest.groupBy(F.col("q0").alias("h0"), F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.sum("size").alias("bytes"))
    heavy = heavy.filter(F.col("bytes") > grain / 4).select("h0", "h1", "h2", F.ceil(F.log2(F.col("bytes") / (grain / 4))).cast("int").alias("bits"))
    rest = rest.join(F.broadcast(heavy), (F.col("q0") == F.col("h0")) & (F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2")), "left")
    high = F.shiftrightunsigned("tie", 40)  # 24 bits
    lead = F.floor(high / F.pow(F.lit(2.0), 24 - F.least("bits", F.lit(24)))).cast("long")
    rest = C.cut(rest.withColumn("tie", F.coalesce(lead, F.lit(0))).drop("h0", "h1", "h2", "bits"))
    cells = C.cut(rest.groupBy("q0", "q1", "q2", "tie").agg(F.sum("size").alias("bytes")))
    rest = rest.join(tree(cells, room), ["q0", "q1", "q2", "tie"]).select("id", "size", "text_crc32", "shard")
    return done.union(rest)


def with_slots(sharded: DataFrame) -> DataFrame:
    """``sharded`` with each row's slot in its shard, gapless from 0.

    Rows are numbered in groups of a shard, and each group starts where the
    groups before it end, so that no task sorts a whole shard.
    """
    grouped = sharded.withColumn("part", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(SLOT_GROUPS)).cast("int"))
    before = grouped.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = before.select("shard", "part", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbered = grouped.withColumn("at", F.row_number().over(W.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")) - 1)
    return numbered.join(before, ["shard", "part"]).withColumn("slot", (F.col("first") + F.col("at")).cast("long"))


def shard_documents(docs: DataFrame, count: int | None = SHARDS, target_bytes: int | None = None, **columns) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): ``count`` shards, or as many as ``target_bytes`` asks for."""
    meta = metadata(docs, **columns)
    if target_bytes is not None:
        count = max(1, math.ceil((meta.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    return with_slots(C.cut(shards(meta, count))).select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def op9_kd_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(C.table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
