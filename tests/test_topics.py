"""Topics against planted ones and a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograin.operators import text, topics
from heliograin.sources.scratch import cut


def planted(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        mix = rng.dirichlet([0.2] * 3)
        drawn = rng.choice(3, size=60, p=mix)
        rows.append((i, " ".join(f"w{t}x{rng.integers(15)}" for t in drawn)))
    return spark.createDataFrame(rows, "doc long, body string").repartition(5)


def held(docs, size):
    counts = text.term_counts(docs, "doc", text.alphanumeric_tokens(F.col("body")))
    terms = topics.vocabulary(counts, size)
    return terms, cut(topics.bags(counts, terms))


def test_planted_topics_are_found(spark):
    terms, bags = held(planted(spark), 100)
    assert len(terms) == 45
    first = topics.Topics.first(terms, 3)
    model, history = topics.train(bags, first, 15)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:]))
    by_topic = {}
    for t, _, w, _ in topics.top_terms(model, 15):
        by_topic.setdefault(t, set()).add(w[:2])
    assert sorted(map(sorted, by_topic.values())) == [["w0"], ["w1"], ["w2"]]
    assert topics.perplexity(bags, model) < 0.8 * topics.perplexity(bags, first)
    shares = topics.mixes(bags, model).collect()
    assert len(shares) == 240 and all(sum(r.shares) == pytest.approx(1) for r in shares)


def test_a_round_equals_a_plain_loop(spark):
    terms, bags = held(planted(spark, 30), 20)
    model = topics.Topics.first(terms, 2, 0.3, 0.2, seed=4)
    new, objective, likely, words = topics.one_round(bags, model)
    sums, want, prior, n = np.full((2, len(terms)), 0.2), 0.0, 0.0, 0
    for r in bags.collect():
        mix = [0.5, 0.5]
        for _ in range(3000):
            grown = [0.3, 0.3]
            for w, c in zip(r.places, r.counts):
                p = sum(mix[t] * model.weights[t, w] for t in (0, 1))
                for t in (0, 1):
                    grown[t] += c * mix[t] * model.weights[t, w] / p
            mix = [g / sum(grown) for g in grown]
        for w, c in zip(r.places, r.counts):
            p = sum(mix[t] * model.weights[t, w] for t in (0, 1))
            want, n = want + c * math.log(p), n + c
            for t in (0, 1):
                sums[t, w] += c * mix[t] * model.weights[t, w] / p
        prior += 0.3 * sum(map(math.log, mix))
    assert words == n and likely == pytest.approx(want, rel=1e-5)
    assert objective == pytest.approx(want + prior + 0.2 * np.log(model.weights).sum(), rel=1e-5)
    assert np.allclose(new.weights, sums / sums.sum(axis=1, keepdims=True), atol=1e-3)


def test_blocks_do_not_change_a_round(spark):
    terms, bags = held(planted(spark, 40), 45)
    parts = [(b.places, b.counts) for b in bags.collect()]
    model = topics.Topics.first(terms, 3)
    whole = topics.expected(model, np.cumsum([0] + [len(p) for p, _ in parts])[:-1], np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]).astype(float))
    alone = [topics.expected(model, np.array([0]), np.array(p), np.array(c, float)) for p, c in parts]
    assert np.allclose(whole[0], sum(a[0] for a in alone), atol=2e-2) and whole[1] == pytest.approx(sum(a[1] for a in alone), rel=1e-5)


def test_vocabulary_ties_and_documents_without_terms(spark):
    docs = spark.createDataFrame([(1, "b a"), (2, "a b c"), (3, "zz"), (4, ""), (5, None)], "doc long, body string")
    terms, bags = held(docs, 3)
    assert terms == ["a", "b", "c"]
    assert sorted(r.id for r in bags.collect()) == [1, 2]
    terms, bags = held(docs.filter("false"), 3)
    model, history = topics.train(bags, topics.Topics.first(terms, 2), 5)
    assert terms == [] and topics.top_terms(model, 5) == [] and len(history) == 1
    assert topics.perplexity(bags, model) == math.inf and topics.mixes(bags, model).count() == 0
    with pytest.raises(ValueError):
        topics.Topics.first(["a"] * 10, 1_000_000)


def test_words_are_counted_once(spark):
    odd = [(3, "w0x1 w0x1"), (3, None), (90, "zz"), (91, None), (92, ""), (None, "a b a"), (None, "b c")]
    docs = planted(spark, 30).union(spark.createDataFrame(odd, "doc long, body string")).repartition(3)
    words = text.alphanumeric_tokens(F.col("body"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # documents go on in the next batch
    try:
        kept = topics.gathered(docs.union(docs.filter("doc < 20 or doc is null")), "doc", words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = text.term_counts(docs.union(docs.filter("doc < 20 or doc is null")), "doc", words)
    assert sorted((str(r.id), t, n) for r in kept.collect() for t, n in zip(r.terms, r.ns)) == sorted((str(r.id), r.term, r.n) for r in counts.collect())
    assert kept.count() == 32 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    terms = topics.vocabulary(kept.select("id", F.explode("terms").alias("term")), 20)
    assert terms == topics.vocabulary(counts, 20)
    plain = {}
    for r in counts.filter(F.col("term").isin(terms)).collect():
        plain.setdefault(r.id, []).append((terms.index(r.term), r.n))
    for made in (topics.bags(kept, terms), topics.bags(counts, terms)):
        assert {r.id: list(zip(r.places, r.counts)) for r in made.collect()} == {i: sorted(b) for i, b in plain.items()}


def test_bags_of_like_sizes_stand_side_by_side():
    sizes = np.array([1, 900, 5, 1000, 6, 2, 60_000, 7])
    assert [sizes[r].tolist() for r in topics._alike(sizes)] == [[1, 2, 5], [6, 7], [900, 1000], [60_000]]
