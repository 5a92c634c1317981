"""Spelling variants against a plain implementation."""

import random
import re
import zlib
from collections import Counter

import pytest

from heliograin.llm import spelling_variants as V


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(n, times=10):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w in n:
        close = [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, ()) if near(w, x)]
        count[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], count[w], form[w], n.get(form[w]), root))
    return out


def found(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("sizes", [(4096, 1 << 20), (3, 1 << 20), (4096, 40)])
def test_near_words_of_a_dense_dictionary(spark, sizes):
    rng = random.Random(5)
    n = {}
    for length in (7, 8, 9, 10, 13):
        for _ in range(250):
            n["".join(rng.choice("abé") if rng.random() < 0.6 else "a" for _ in range(length))] = int(10 ** rng.uniform(0.4, 5))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = found(V.group_variants(words, most_words=sizes[0], most_cells=sizes[1]))
    assert got == plain(n)
    assert len({r[5] for r in got}) < 0.8 * len(got)


def test_one_hot_half_and_long_words(spark):
    rng = random.Random(6)
    letters = "abcdefghij"
    n = {"hotstart" + "".join(rng.choice(letters[:3]) for _ in range(7)): rng.randint(2, 90) for _ in range(900)}
    n |= {"".join(rng.choice(letters[:3]) for _ in range(7)) + "hotended": rng.randint(2, 90) for _ in range(900)}
    long = "".join(rng.choice(letters) for _ in range(5000))
    n |= {long: 500, long[:2500] + long[2501:]: 20, long[:100] + "z" + long[101:]: 2, long + "y": 3, "z" + long: 4}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(V.group_variants(words, most_words=64, most_cells=1 << 14)) == plain(n)


def test_query_on_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = plain(plain_words(docs))
    assert found(V.op11_spelling_variants(spark, data)) == want
    assert any(r[3] is not None for r in want) and any(r[2] for r in want)


def test_edges(spark):
    rows = [(None, "Straßen straßen ÀBCDEFG ÀBCDEFG", 1), (1, None, 2), (1, "", 3), (2, "abcdefgh" * 3000 + " x1y2", 4), (3, "abcdefgh" * 3000, 5), (3, "abcdefgh" * 3000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long")
    assert found(V.group_variants(V.count_words(docs))) == plain(plain_words([(i, t) for i, t, _ in rows]))
    assert found(V.group_variants(V.count_words(docs.limit(0)))) == set()
