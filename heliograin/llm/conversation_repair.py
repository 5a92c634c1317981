"""Operator 13: conversation structure repair.

A conversation is repaired by edits of its rows in order: Keep, Rerole to user
or assistant, Delete, and Insert of an empty row of user or assistant, so that the initials of
its roles read ``(s?(ua)+)?``. The cheapest repair is a shortest path on the implicit
lattice of (rows consumed, grammar state), found by Dijkstra's algorithm with the
key (cost, audit), which stops at the first accepting end node that it pops.
The audit is the string of the edits' initials, so ties go to the least one.
(At one node two audits of equal cost are never prefixes of each other, as what
one has more would be inserts, which cost; so the least audit stays least when it is extended.)

Rows are ranked by conversation and turn in range partitions, so a conversation
of any share of all rows is spread. Faults are found on narrow rows: duplicates by the
least rank of each (conversation, role, text digest), one aggregate and a join on the unique ranks.
Ranks are dealt into pieces of PIECE rows. A conversation inside one piece is repaired
there; one that crosses pieces gets a path for each pair of states at a piece's ends
(only a piece that starts at a multiple of PIECE can be a later one), and a
pass over its pieces composes them, with four audits held at a time. Edits go back to the rows by rank.

Defined results: null roles and texts (and, in the damage hash, ids and turns) read as
one space; rows of one turn stand in the order of role and text; an empty role, like one of another initial
than s, u or a, can't be kept; a null conv_id is a conversation of its own; null turns
come first; repeated rows are duplicates; rows of any length and conversations of any number of rows
are whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PIECE = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
_ENDS = frozenset((NOTHING, AFTER_A))
#: What rerole and insert make in each state.
_MADE = ("user", "user", "assistant", "user")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that the rows' hashes choose."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(held("text"), "[.!?]", "")).otherwise(held("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(held("role"))
    made = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.withColumn("copy", times).select("conv_id", "turn", "role", "text")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, gapless over the whole table in the order of conversation, turn, role and text; written once."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", held("role").alias("role"), held("text").alias("text"))
    # equal rows need an order of their own
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    return C.running(rows, order, rank=F.lit(1).cast("long")).withColumnRenamed("before_rank", "rank").drop("tie")


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, rank, turn, initial, fault) of ranked rows; fault is B, D, T or empty."""
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    trimmed = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    last = F.right(trimmed, F.lit(1))
    narrow = rows.select("conv_id", "rank", "turn", F.substring("role", 1, 1).alias("initial"), (F.length(trimmed) == 0).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), digest.alias("digest"))
    narrow = C.cut(narrow)
    first = narrow.groupBy("conv_id", "digest").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), F.lit("B")).when(F.col("is_first").isNull(), F.lit("D")).when(F.col("cut"), F.lit("T")).otherwise(F.lit(""))
    return narrow.join(first, "rank", "left").select("conv_id", "rank", "turn", "initial", fault.alias("fault"))


def paths(rows: list[tuple[str, str]], start: int, ends=_ENDS, all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits of rows (initial, fault) from a state to the first popped of ``ends``, or to each state."""
    n, done, found = len(rows), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if all_ends:
                found[state] = (cost, audit)
                if len(found) == 4:
                    return found
            elif state in ends:
                return {state: (cost, audit)}
        made = _NEXT[state]["ua"[state == AFTER_U]]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, made))
        if i < n:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in ("B", "D"):
                more = TRUNCATED if fault == "T" else 0
                if initial in _NEXT[state]:
                    heapq.heappush(heap, (cost + KEEP + more, audit + "K", i + 1, _NEXT[state][initial]))
                heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, made))
    return found  # (some states can't be reached from where the piece starts)


def _pieces(piece: int):
    def run(batches):
        for b in batches:
            out = []
            for conv, of, rows in zip(*(b.column(k).to_pylist() for k in range(3))):
                codes = [(r["initial"], r["fault"]) for r in rows]
                lo, hi = rows[0]["rank"], rows[-1]["rank"]
                alone = lo % piece > 0 and hi % piece < piece - 1  # neither may another piece come before nor after
                starts = (NOTHING,) if lo % piece else range(4)
                made = [(s, e, *v) for s in starts for e, v in paths(codes, s, all_ends=not alone).items()]
                states = [[x[k] for x in made] for k in range(4)]
                pairs = sum(1 for (x, _), (y, _) in zip(codes, codes[1:]) if x + y not in ("su", "ua", "au"))
                kinds = [x for _, x in codes]
                out.append((conv, lo, hi, codes[0][0], codes[-1][0], pairs, kinds.count("B"), kinds.count("D"), kinds.count("T"), *states))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(_PIECE_COLUMNS)], [n for n, _ in _PIECE_COLUMNS])

    return run


_PIECE_COLUMNS = [(n, pa.int64()) for n in ("conv_id", "lo", "hi")] + [("head", pa.string()), ("tail", pa.string())] + [(n, pa.int64()) for n in ("illegal", "blank", "duplicate", "truncated")]
_PIECE_COLUMNS += [(n, pa.list_(pa.int32())) for n in ("starts", "stops")] + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
_PIECE_SCHEMA = "conv_id long, lo long, hi long, head string, tail string, illegal long, blank long, duplicate long, truncated long, starts array<int>, stops array<int>, costs array<long>, audits array<string>"


def _joined(batches):
    """Composes a conversation's pieces, in order; four (cost, audit) are held."""
    names = ["conv_id", "lo", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [pa.int64()] * 7 + [pa.string()]
    for b in batches:
        out = []
        for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            best, illegal, before = {NOTHING: (0, "")}, 0, None
            for p in parts:
                after: dict[int, tuple[int, str]] = {}
                for s, e, cost, audit in zip(p["starts"], p["stops"], p["costs"], p["audits"]):
                    if s in best:
                        way = (best[s][0] + cost, best[s][1] + audit)
                        after[e] = min(after.get(e, way), way)
                best = after
                illegal += p["illegal"] + (before is not None and before + p["head"] not in ("su", "ua", "au"))
                before = p["tail"]
            cost, audit = min(best[e] for e in _ENDS if e in best)
            out.append((conv, parts[0]["lo"], *(sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def plan(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows (conv_id, lo, blank, duplicate, truncated, illegal, cost, audit) of rows (conv_id, rank, initial, fault); ``lo`` is the first rank."""
    code = F.struct("rank", "initial", "fault")
    pieces = rows.groupBy("conv_id", F.floor(F.col("rank") / piece).alias("piece")).agg(F.sort_array(F.collect_list(code)).alias("rows"))
    pieces = pieces.mapInArrow(C.tidy(_pieces(piece)), _PIECE_SCHEMA)
    part = F.struct("lo", *[n for n, _ in _PIECE_COLUMNS[3:]])
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.mapInArrow(C.tidy(_joined), "conv_id long, lo long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edits(plans: DataFrame) -> DataFrame:
    """Rows (rank, edit, role, before, after): each row's edit, its new role, and the roles of the rows inserted before it and after the last one."""
    names, kinds = ["rank", "edit", "role", "before", "after"], [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches):
        made = []
        for b in batches:
            for lo, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # roles alternate from user on, behind a system row if their number is odd
                place = -((len(audit) - audit.count("D")) % 2)
                at, lead = lo, []
                for edit in audit:
                    role = ("user", "assistant")[place % 2]
                    place += edit != "D"
                    if edit == "I":
                        lead.append(role)
                        continue
                    if len(made) >= 8192:
                        yield packed(made)
                        made = []
                    made.append([at, edit, role if edit == "R" else None, lead, []])
                    at, lead = at + 1, []
                if lead:
                    made[-1][4] = lead
        yield packed(made)

    return plans.select("lo", "audit").mapInArrow(C.tidy(run), "rank long, edit string, role string, before array<string>, after array<string>")


def apply(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (conv_id, rank, place, edit, turn, role, text) of the repaired conversations, in the order of rank and place; inserted rows have no turn."""
    steps = steps.withColumnRenamed("role", "new_role")
    line = lambda edit, turn, role, text: F.struct(F.lit(edit).alias("edit") if isinstance(edit, str) else edit.alias("edit"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    inserted = lambda roles: F.transform(roles, lambda r: line("I", F.lit(None).cast(rows.schema["turn"].dataType), r, F.lit("")))
    own = line(F.col("edit"), F.col("turn"), F.coalesce("new_role", "role"), F.col("text"))
    lines = F.concat(inserted(F.col("before")), F.filter(F.array(own), lambda x: x["edit"] != "D"), inserted(F.col("after")))
    made = rows.join(steps, "rank").select("conv_id", "rank", F.posexplode(lines).alias("place", "row"))
    return made.select("conv_id", "rank", "place", "row.*")


def repair(conversations: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked rows with their faults, the conversations' plans, and the repaired rows."""
    rows = ranked(conversations)
    faulty = C.cut(faults(rows))
    plans = C.cut(plan(faulty, piece))
    return faulty, plans, apply(rows, edits(plans))


def digests(repaired: DataFrame) -> DataFrame:
    """Rows (conv_id, sha256) of the repaired ``role:text``, joined by newlines.

    Such a digest is sequential: a conversation's rows pass through one task, sorted, one batch held at a time.
    """

    def run(batches):
        names = ["conv_id", "sha256"]
        made, of, digest = [], None, None
        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if digest is None or conv != of:
                    if digest is not None:
                        made.append((of, digest.hexdigest()))
                    of, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([x for _, x in made], pa.string())], names)
            made = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([digest.hexdigest()])], names)

    parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = repaired.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "rank", "place").select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text")
    return rows.mapInArrow(C.tidy(run), "conv_id long, sha256 string")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = C.table(spark, sf_dir, "conversations")
    faulty, plans, repaired = repair(damage(conversations))
    turns = faulty.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for found in (plans.drop("lo"), turns, digests(repaired)):
        found = found.withColumnRenamed("conv_id", "of")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *whole, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
