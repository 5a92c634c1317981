"""Texts that repeat themselves, words made to collide, tables of short texts and rows without an id."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest

from heliograin.llm import decontamination, html_extraction, license_scan, simhash_dedup, source_mixing, substring_dedup, token_store
from heliograin.llm import common as C

WORD_BPE = "word_bpe_49k.json"


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(docs)
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in found.collect()), key=str)


@pytest.mark.parametrize("texts", [["hello world again", "", "more words of text here"], [None, None, ""], ["one"], [" ".join(f"w{i}" for i in range(20))], [None]])
def test_substring_dedup_of_short_texts_only(spark, texts):
    got = removed(spark, list(enumerate(texts)))
    assert got == sorted(((i, len((t or "").split()), 0, t or "") for i, t in enumerate(texts)), key=str)


def test_a_group_emptied_after_the_first_level(spark):
    some = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(some[:20] + [f"x{i}" for i in range(20)])), (2, " ".join(some[:20] + [f"y{i}" for i in range(20)]))]
    assert [r[2] for r in removed(spark, rows)] == [0, 0]


def test_words_that_collide_under_plain_polynomials(spark):
    a, b = thue_morse(1024, 0), thue_morse(1024, 1)
    around = [f"w{i}" for i in range(34)]
    got = removed(spark, [(1, " ".join([a, *around])), (2, " ".join([b, *around]))])
    assert [r[2] for r in got] == [0, 0]
    data, off = C.flat(pa.array([a, b]))
    for seed in (11, 12, 61, 62):
        x, y = C.Hasher(seed).words(data, off[:-1], off[1:])
        assert x != y
    # and sequences of two words in that order
    texts = [" ".join({"a": "left", "b": "right"}[c] for c in t) for t in (a, b)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    h = C.Hasher(61)
    data, off = C.flat(pa.array(texts))
    starts, ends, first = C.words(data, off)
    x, y = h.sequences(h.words(data, starts, ends), first)
    assert x != y
    assert simhash_dedup.keep_first(docs.union(docs)).count() <= 2


def test_tokens_of_rows_without_an_id(spark):
    import public_tokenizers

    rows = [(None, "some text"), (3, "x y"), (None, None), (None, "some text"), (-5, "ab")]
    path = token_store.shard_path(spark)
    token_store.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path(WORD_BPE))
    got = sorted((r.start, r.id, r.n_tokens) for r in token_store.read_documents(spark, path).collect())
    assert [i for _, i, _ in got] == [None, None, None, -5, 3]
    assert [s for s, _, _ in got] == np.cumsum([0, *[n for *_, n in got]])[:-1].tolist()
    found = token_store.occurrences(spark, path, 2).collect()
    assert sorted(str(r.id) for r in found) == ["-5", "3", "None", "None", "None"]
    assert token_store.count_token(spark, path, 2).first().n == 5


def test_pipeline_of_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    words = "the of and to in that is was for on are with as at be this have from by an".split()
    rows = [(None if i % 2 else i, " ".join(words[(i * 7 + k * k) % 20] + str((i * k) % 13) for k in range(40)) + " end.", "en", "s", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item that is nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert any(r.doc_id is None for r in got) and any(r.doc_id is not None for r in got)


def test_an_item_of_one_word_in_a_text_of_it():
    """Linear in the text: a work count, not a clock, would be better, but quadratic work would take minutes."""
    index = decontamination.Index([(1, "la " * 2000), (2, "la li " * 300)])
    h = decontamination.hashes(["la " * 300_000, "la li " * 20_000])
    first = np.array([0, len(h[0]), len(h[0]) + len(h[1])])
    began = time.process_time()
    best = decontamination.scan(np.concatenate(h), first, index, 0.8)
    assert time.process_time() - began < 60
    assert best[0, 1][0] == 1.0 and best[1, 2][0] == 1.0


def test_best_start_slides_like_plain_counts():
    rng = np.random.default_rng(4)
    for n in (1, 3, 5, 9, 17):
        for _ in range(30):
            h = rng.integers(0, 3, 40).astype(np.uint64)
            item = rng.integers(0, 3, n).astype(np.uint64)
            counts, f, e = decontamination.shingles(item), 4, int(rng.integers(5, 40))
            lo, hi = -5, 45
            want = (0.0, 0, 0)
            for s in range(max(lo, f - n + 1), min(hi, e - 1) + 1):
                a, z = max(s, f), min(s + n, e)
                v = decontamination.similarity(counts, decontamination.shingles(h[a:z]))
                if v > want[0]:
                    want = (v, a, z)
            got = decontamination.best_start(h, f, e, n, counts, lo, hi)
            assert got[0] == want[0] and (not want[0] or got == want)


def test_many_notices_in_one_text(spark):
    notice = dict(license_scan.TEMPLATES)
    name, text = next(iter(notice.items()))
    filler = " ".join(f"f{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{text} {filler} " * 1500), (1, text), (None, text), (2, "nothing")], "doc_id long, text string")
    got = license_scan.matches(docs).groupBy("id", "license").count().collect()
    assert sorted((str(r.id), r["count"]) for r in got if r.license == name) == [("1", 1501), ("None", 1)]


@pytest.mark.parametrize("n", [41, 60, 100])
def test_all_of_many_named_articles(spark, n):
    code = lambda i: "".join("abcdefghij"[int(c)] for c in str(100 + i))
    body = lambda i: "".join(f"<p>Sentence {i} {k} with some words in it.</p>" for k in range(4))
    page = "<html><body><nav>menu</nav>" + "".join(f"<div class='w{code(i)}'><article>{body(i)}</article></div>" for i in range(n)) + "<footer>foot</footer></body></html>"
    text = html_extraction.article(page, None)
    assert [i for i in range(n) if f"Sentence {i} 3 with" not in text] == []
    assert "menu" not in text and "foot" not in text
    pages = spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")
    assert html_extraction.extract(pages).first().text == text


def test_articles_below_the_depth_that_wrappers_keep():
    deep = "<div>" * 130 + "<article><p>Deep words of an article.</p></article>" + "</div>" * 130
    page = f"<html><body><article><p>{'Upper words here. ' * 5}</p></article>{deep}</body></html>"
    assert "Deep words" in html_extraction.article(page, None)


@pytest.mark.parametrize(
    "part, kept",
    [
        ("<div class='article-teaser'>Lead of it.</div>", "Lead of it."),
        ("<section id='related-work'><p>Others did so.</p></section>", "Others did so."),
        ("<div class='social-history'>Long ago.</div>", "Long ago."),
        ("<p>where <math><mi>x</mi></math> is</p>", "where x is"),
        ("<div><select><option>No</div><p>Still here.</p>", "Still here."),
        ("<p>See <object data='x'>the drawing</object></p><p>Later.</p>", "Later."),
        ("<div class='share-buttons'>Tweet</div><p>Text.</p>", "Text."),
    ],
)
def test_parts_of_articles_stay(part, kept):
    page = f"<html><body><article><p>{'Some words of the article. ' * 8}</p>{part}<p>The end.</p></article></body></html>"
    text = html_extraction.article(page, None)
    assert kept in text and text.endswith("The end.")
    assert "No" not in text.split() and "Tweet" not in text
