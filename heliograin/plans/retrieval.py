"""Retrieval queries over embeddings and benchmark items: every id divisible by 20 asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import retrieval, text
from heliograin.plans.base import query, rounded, table
from heliograin.plans.text import COUNTS, DOC_COUNTS

COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
TOP = f"top AS (SELECT q.vec_id AS query, e.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id)::INT AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)"


def _dense(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.dense_search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query(f"WITH {TOP} SELECT query, id, round(score, 6) AS score, rank FROM top")
def retrieval_dense_top_k(spark, d):
    return rounded(_dense(spark, d), 6)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def retrieval_norms(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", retrieval.norm(F.col("embedding")).alias("norm")), 6)


@query(f"SELECT q.vec_id AS a, e.vec_id AS b, round({COS}, 6) AS cosine FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1")
def retrieval_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return rounded(e.join(o, "vec_id").select(F.col("vec_id").alias("a"), "b", retrieval.cosine(F.col("embedding"), F.col("other")).alias("cosine")), 6)


@query()
def retrieval_lsh_top_k(spark, d):
    e = table(spark, d, "embeddings")
    dim = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return rounded(retrieval.lsh_search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", dim, 10), 6)


@query()
def retrieval_ivf_top_k(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(retrieval.ivf_search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10), 6)


@query(f"WITH {TOP} SELECT query, id, round(score, 6) AS score, rank FROM top")
def retrieval_ivf_full_probe(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(retrieval.ivf_search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, lists=16, probes=16), 6)


BM25 = (
    f"{COUNTS}, {DOC_COUNTS}, f AS (SELECT term, count(*) AS df FROM dcounts GROUP BY ALL), s AS (SELECT count(*) AS docs, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM dcounts)), "
    "q AS (SELECT id AS query, term, n AS m FROM counts WHERE id % 20 = 0), bm AS (SELECT query, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN dcounts USING (term) JOIN f USING (term), s GROUP BY ALL), "
    "bt AS (SELECT query, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id))::INT AS rank FROM bm QUALIFY rank <= 10)"
)


def _terms(spark, d):
    """Term counts of documents, and those of the benchmark items that ask."""
    docs = text.term_counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", text.alphanumeric_tokens(F.col("text")))
    items = table(spark, d, "benchmark").filter("item_id % 20 = 0")
    return docs, text.term_counts(items, "item_id", text.alphanumeric_tokens(F.col("text")))


def _bm25(spark, d):
    docs, asked = _terms(spark, d)
    s = docs.select("id", "length").distinct().agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"))
    scored = retrieval.bm25(docs, asked.select(F.col("id").alias("query"), "term"), s)
    return retrieval.top_k(rounded(scored, 9), "query", "score", "id", 10)


@query(f"WITH {BM25} SELECT query, id, score, rank FROM bt")
def retrieval_bm25(spark, d):
    return rounded(_bm25(spark, d).select("query", "id", "score", "rank"), 6)


@query(
    f"WITH {BM25}, o AS (SELECT id, sqrt(sum(n * n)) AS norm FROM dcounts GROUP BY ALL), p AS (SELECT query, sqrt(sum(m * m)) AS norm FROM q GROUP BY ALL), c AS (SELECT query, id, sum(m * n) AS dot FROM q JOIN dcounts USING (term) GROUP BY ALL), "
    "ct AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(dot / (o.norm * p.norm), 9) DESC, id) AS rank FROM c JOIN o USING (id) JOIN p USING (query) QUALIFY rank <= 10) "
    "SELECT query, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT query, id, rank FROM bt UNION ALL SELECT query, id, rank FROM ct) GROUP BY ALL"
)
def retrieval_hybrid_fusion(spark, d):
    docs, asked = _terms(spark, d)
    near = retrieval.top_k(rounded(text.pair_similarity(docs, asked, "cosine", within=False).withColumnRenamed("similarity", "score"), 9), "query", "score", "id", 10)
    both = [x.select("query", "id", "rank") for x in (_bm25(spark, d), near)]
    return rounded(retrieval.rank_fusion(both[0].union(both[1])), 8)


@query(
    f"WITH {TOP}, rel AS (SELECT q.vec_id AS query, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0), n AS (SELECT query, count(*) AS n FROM rel GROUP BY ALL), "
    "h AS (SELECT t.query, rank, (r.id IS NOT NULL)::INT AS hit, sum((r.id IS NOT NULL)::INT) OVER (PARTITION BY t.query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM top t LEFT JOIN rel r ON t.query = r.query AND t.id = r.id) "
    "SELECT h.query, round(sum(hit) / any_value(n), 6) AS recall, round(sum(hit) / 10, 6) AS precision, round(max(hit / rank), 6) AS reciprocal_rank, round(sum(hit * seen / rank) / least(10, any_value(n)), 6) AS average_precision, "
    "round(sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, least(10, any_value(n)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM h JOIN n ON h.query = n.query GROUP BY ALL"
)
def retrieval_metrics(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    rel = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").filter("query <> id").select("query", "id")
    return rounded(retrieval.ranking_metrics(_dense(spark, d).select("query", "id", "rank"), rel, 10), 6)


@query(f"WITH {TOP}, b AS (SELECT query, id, rank, sum(id % 300) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM top) SELECT query, id, rank, upto FROM b WHERE upto <= 900")
def retrieval_context_budget(spark, d):
    return retrieval.within_budget(_dense(spark, d).withColumn("length", F.col("id") % 300), "length", 900).select("query", "id", "rank", "upto")


@query("WITH m AS (SELECT event_id, user_id, value / 100 + 0.5 ** ((max(epoch_us(ts)) OVER () - epoch_us(ts)) / 1e6 / 86400 / 7) AS s FROM events) SELECT user_id, event_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) <= 10")
def retrieval_bounded_memory(spark, d):
    from heliograin.plans.base import events

    e = events(spark, d)
    last = e.agg(F.max("t").alias("last"))
    aged = e.join(F.broadcast(last), how="cross").select("user_id", "event_id", (F.col("value") / 100).alias("importance"), ((F.col("last") - F.col("t")) / 86400).alias("age"))  # one row
    return retrieval.bounded_memory(aged, ["user_id"], "importance", "age", "event_id", 10, 7.0).select("user_id", "event_id")


@query(
    "WITH p AS (SELECT vec_id, [embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[]] AS a, [embedding[33:48]::DOUBLE[], embedding[49:64]::DOUBLE[]] AS b FROM embeddings) SELECT vec_id, round(list_sum(list_transform(a, lambda q: list_max(list_transform(b, lambda e: list_cosine_similarity(q, e))))), 6) AS score FROM p"
)
def retrieval_late_interaction(spark, d):
    part = lambda k: F.slice("embedding", 16 * k + 1, 16)
    return rounded(table(spark, d, "embeddings").select("vec_id", retrieval.max_sim(F.array(part(0), part(1)), F.array(part(2), part(3))).alias("score")), 6)
