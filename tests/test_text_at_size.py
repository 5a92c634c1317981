"""Text operators: documents stay in one place, copies are one class, expressions are made once."""

from itertools import permutations

from pyspark.sql import functions as F

from heliograin import catalog
from heliograin.operators import retrieval, text


def words():
    return text.alphanumeric_tokens(F.col("text"))


def test_words_are_dealt_by_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    counts = text.term_counts(docs, "doc_id", words())
    found = text.top_keywords(text.tf_idf(counts, docs.agg(F.count("*"))), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "SortMergeJoin" not in plan
    asked = counts.filter("id % 20 = 0").select(F.col("id").alias("query"), "term")
    s = counts.select("id", "length").distinct().agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))
    plan = retrieval.bm25(counts, asked, s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftSemi, BuildRight" in plan


def test_copies_link_as_a_class(spark):
    texts = ["a b c d", "d c b a a", "a b c e", "x y", "y x x", "z"] * 4 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = text.term_counts(docs, "doc_id", words())
    got = {(r["query"], r["id"]): r["similarity"] for r in text.jaccard_above(c, c.filter("id % 5 = 0"), 0.5).collect()}
    sets = {k: set(t.split()) for k, t in enumerate(texts) if t}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in permutations(sets, 2) if a % 5 == 0}
    assert got == {k: v for k, v in want.items() if v >= 0.5}


def test_a_long_sentence_is_cut_once(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(6000))  # its words, made for each of its places, would be 36 million
    rows = [(k, f"{long} OF\tThe {long}. none of that. of the end") for k in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["text_relations"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["subject"] == long, r["object"] == long, r["n"]) for r in got) == [(k, True, True, 1) for k in range(8)]
