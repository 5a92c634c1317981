"""Conversation repair against enumeration of all edits and against a plain implementation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from heliograin.llm import conversation_repair as R

GRAMMAR = re.compile("(s?(ua)+)?")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def outcome(rows, audit):
    """Cost and repaired rows (role, text) of an audit's edits of rows (role, text, fault), or None if they aren't allowed; roles of R and I are tried both."""
    used = sum(c != "I" for c in audit)
    if used != len(rows):
        return None
    best = None
    free = [k for k, c in enumerate(audit) if c in "RI"]
    for roles in itertools.product(("user", "assistant"), repeat=len(free)):
        named, cost, at, out = dict(zip(free, roles)), 0, 0, []
        for k, c in enumerate(audit):
            if c == "I":
                out.append((named[k], ""))
                cost += 3
                continue
            role, text, fault = rows[at]
            at += 1
            if c == "D":
                cost += 4
            elif fault in ("B", "D"):
                break
            else:
                out.append((named.get(k, role), text))
                cost += (3 if c == "R" else 0) + (3 if fault == "T" else 0)
        else:
            initials = [r[:1] or "?" for r, _ in out]
            if GRAMMAR.fullmatch("".join(initials)) and (best is None or cost < best[0]):
                best = (cost, out)
    return best


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = NON_SPACE.findall(text)
        fault = "B" if not marks else "D" if (role, text) in seen else "" if marks[-1] in ".!?" else "T"
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows):
    """Cheapest (cost, audit, repaired) of rows (role, text, fault) by relaxing whole layers."""
    inf = (1 << 60, "", [])
    best = {"": (0, "", [])}
    nxt = lambda g, r: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[g].get(r)
    full = {"u": "user", "a": "assistant"}

    def put(into, g, way):
        if way[:2] < into.get(g, inf)[:2]:
            into[g] = way

    def inserts(layer):
        for _ in range(4):
            for g, (c, a, out) in list(layer.items()):
                for r in "ua":
                    if nxt(g, r):
                        put(layer, nxt(g, r), (c + 3, a + "I", out + [(full[r], "")]))

    inserts(best)
    for role, text, fault in rows:
        after = {}
        for g, (c, a, out) in best.items():
            put(after, g, (c + 4, a + "D", out))
            if fault not in ("B", "D"):
                more = 3 if fault == "T" else 0
                if role[:1] and nxt(g, role[0]):
                    put(after, nxt(g, role[0]), (c + more, a + "K", out + [(role, text)]))
                for r in "ua":
                    if nxt(g, r):
                        put(after, nxt(g, r), (c + 3 + more, a + "R", out + [(full[r], text)]))
        inserts(after)
        best = after
    return min((best[g] for g in ("", "a") if g in best), key=lambda w: w[:2])


def plain(rows):
    """Result rows by conversation of rows (conv_id, turn, role, text) before damage."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    out = set()
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = plain_faults([r[1:] for r in found])
        initials = [r[1][:1] for r in found]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit, made = plain_repair([(r, t, f) for (_, r, t), f in zip(found, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.add((conv, gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit, digest))
    return out


def found(df):
    return {(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_paths_are_the_cheapest_of_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(("user", "assistant", "system", "tool", "")), f"t{k}", rng.choice(("", "", "", "B", "D", "T"))) for k in range(rng.randint(0, 4))]
        tried = []
        for n in range(len(rows) + 3):
            for audit in map("".join, itertools.product("KRDI", repeat=n)):
                if audit.count("I") <= 2 and (got := outcome(rows, audit)):
                    tried.append((got[0], audit, got[1]))
        want = min(tried, key=lambda x: x[:2])
        (got,) = R.paths([(r[:1], f) for r, _, f in rows], R.NOTHING).values()
        assert got == want[:2]
        assert plain_repair(rows) == want


def test_query_on_conversations(spark, data):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    got = found(R.op13_conversation_repair(spark, data))
    assert got == plain(rows)
    folder = data.replace("sf0.001", "sf0.01")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = found(R.op13_conversation_repair(spark, folder))
    assert got == plain(rows) and {"R", "D", "I"} <= set("".join(r[7] for r in got))


@pytest.mark.parametrize("piece", [3, 16, 1024])
def test_long_conversations_over_many_pieces(spark, tmp_path, piece, monkeypatch):
    rng = random.Random(piece)
    rows = []
    for conv, n in ((1, 400), (2, 7), (3, 1), (None, 60), (5, 33), (6, 2)):
        role = 0
        for turn in range(n):
            role = (role + (rng.random() < 0.8)) % 2
            name = ("user", "assistant")[role] if rng.random() < 0.9 else rng.choice(("system", "tool", None))
            rows.append((conv, turn + (turn > 5), name, rng.choice((f"said {turn}.", f"cut {turn}", "same.", None, "  "))))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(R.plan, "__defaults__", (piece,))
    monkeypatch.setattr(R.repair, "__defaults__", (piece,))
    assert found(R.op13_conversation_repair(spark, str(tmp_path))) == plain(rows)


def test_edges(spark, tmp_path):
    long = "word " * 50_000 + "end."
    rows = [(1, None, None, None), (1, None, "user", long), (1, 3, "assistant", long), (1, 3, "assistant", long), (2, 1, "", "x."), (2, 2, "user", "é? "), (None, None, "user", "a."), (None, 0, "assistant", "b!")]
    rows += [(k, 0, "user", "hm.") for k in range(10, 60)]
    schema = "conv_id long, turn long, role string, text string, rank long, edit string, fault int"
    for name, found_ in (("full", rows), ("empty", [])):
        spark.createDataFrame([(*r, 1, "x", 2) for r in found_], schema).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = found(R.op13_conversation_repair(spark, f"{tmp_path}/full"))
    assert got == plain(rows)
    gone = [r for r in got if r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest()]
    assert gone and all(r[1:7] == (0,) * 6 for r in gone)
    assert found(R.op13_conversation_repair(spark, f"{tmp_path}/empty")) == set()
