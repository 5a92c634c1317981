"""Quality classifier: plain indicators and counts, the optimum of the hinge loss, held-out accuracy, edges."""

import re
import zlib

import numpy as np
import pyarrow as pa
from heliograin.llm import common as C
from heliograin.llm import quality_classifier as Q


def test_indicators_are_those_of_each_text_alone():
    texts = ["", "Ab ab, ab 12", "x", "THE!! THE!! end.", "é é  1.5\tzz", " "]
    data, off = C.flat(pa.array(texts))
    found = Q.indicators(data, off)
    for k, t in enumerate(texts):
        alone = Q.indicators(*C.flat(pa.array([t])))
        assert (found[found >> Q.BITS == k] & (Q.DIMENSIONS - 1)).tolist() == alone.tolist()
        raw = t.encode()
        grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        shapes = Q.shapes(*C.flat(pa.array([t])))[0].tolist()
        assert len(shapes) == len(words)
        grams |= {tuple(shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}
        assert 0 <= len(grams) - len(alone) <= 1  # but for places that two share


def test_shapes():
    code = lambda t: Q.shapes(*C.flat(pa.array([t])))[0].tolist()
    again = code("De De De")
    assert again[1] == again[2] != again[0]
    assert len(set(code("Abc abc ABC a1c abc. abc! abc, é"))) == 8
    assert code("abc xyz") == [code("abc")[0]] * 2


def test_descent_reaches_the_optimum_of_the_dual():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    sign = np.sign(x @ rng.normal(size=6) + 0.3 * rng.normal(size=80))
    w = Q.descend([(np.arange(6), row) for row in x], sign, 6, cost=0.7, epochs=3000)
    loss = lambda w: 0.5 * w @ w + 0.7 * np.maximum(0, 1 - sign * (x @ w)).sum()
    tried = [loss(w + step * rng.normal(size=6)) for step in (1e-3, 1e-2, 0.1, 1) for _ in range(300)]
    assert loss(w) <= min(tried) + 1e-4


def test_counts_cover_all_rows(spark):
    rows = [(i, f"word{i % 7} THE!! {i % 3}" * (i % 4), i % 5 > 1) for i in range(200)]
    found = spark.createDataFrame([(i, int(g), t) for i, t, g in rows], "id long, good int, body string").repartition(5)
    got = found.select("good", "body").mapInArrow(Q._count, "place long, bad long, good long").groupBy("place").sum("bad", "good").collect()
    want = {-1: [0, 0]}
    for _, t, g in rows:
        want[-1][g] += 1
        for place in Q.indicators(*C.flat(pa.array([t]))).tolist():
            want.setdefault(place, [0, 0])[g] += 1
    assert {r[0]: [r[1], r[2]] for r in got} == want


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op12_quality_classifier(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    apart = [i for i in labels if got[i].held_out]
    assert len(apart) > 100 and sum(got[i].predicted == labels[i] for i in apart) >= 0.98 * len(apart)


def test_edges(spark):
    docs = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (None, "Ab cd", "x"), (3, "THE!! " * 40_000, "x"), (4, "plain words here", "x"), (4, "plain words here", "x"), (5, "A!!", "x")], "doc_id long, text string, score string")
    labels = lambda *r: spark.createDataFrame(list(r), "doc_id long, quality int, good string")
    run = lambda table, rows=docs: [(r.id, r.score) for r in Q.predict(rows, Q.train(Q.labelled(rows, table))).collect()]
    assert [s for _, s in run(labels())] == [0.5] * 7
    assert [s for _, s in run(labels((4, 1, "x"), (None, 0, "x"), (0, None, "x"), (1, 7, "x")))] == [1.0] * 7
    assert [s for _, s in run(labels((4, 0, "x")))] == [0.0] * 7
    both = run(labels((4, 1, "x"), (4, 0, "x"), (3, 0, "x"), (5, 0, "x")))
    assert both[0][1] == both[1][1] and both[4] == both[5] and both[4][1] > 0.5 > both[3][1]
    assert run(labels((4, 1, "x"), (3, 0, "x")), docs.limit(0)) == []
