"""Vector and text retrieval: exact and indexed top-k, BM25, rank fusion, ranking metrics.

Queries are a stated set of rows; they meet all rows in blocks of matrix
products (exact search), by hash buckets (LSH) or by cluster lists (IVF). An
index answers a query where it can be expected to reach ``RECALL``; LSH leaves
the other queries to exact search, IVF probes as many lists as that takes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.sources.scratch import beside, cut

#: Expected share of the true top-k that an index search finds.
RECALL = 0.9
#: Queries that one pass over the rows takes along; more are dealt into passes.
QUERY_BLOCK = 4096
#: Rows of the largest LSH bucket that queries are joined with.
BUCKET = 256
#: Queries on which the number of probed lists is fitted.
PROBE_QUERIES = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def top_k(found: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    w = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie).asc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(vectors) -> np.ndarray:
    x = np.array(vectors.tolist(), float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def dense_search(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """Rows (query, id, score, rank): exact cosine top-k, equal scores by id.

    Blocks of queries go to every batch of rows, which keeps its own k best of
    each query; the final ranking sees k rows from each batch, not all pairs.
    """
    return _search(rows, queries, id_col, vector, k, None, 0)


def _search(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, centres: np.ndarray | None, probes: int) -> DataFrame:
    """Top-k over all rows, or over the rows of each query's ``probes`` nearest centres."""
    spark = rows.sparkSession
    n = queries.count()
    passes = max(1, -(-n // QUERY_BLOCK))
    found = None
    for p in range(passes):
        block = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(passes)) == p).select(id_col, vector).toPandas()
        if not len(block):
            continue
        q = _matrix(block[vector])
        asked = None
        if centres is not None:
            asked = np.zeros((len(q), len(centres)), bool)
            np.put_along_axis(asked, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, 1)
        held = spark.sparkContext.broadcast((block[id_col].to_numpy(), q, asked))

        def run(batches, held=held):
            names, q, asked = held.value
            for b in batches:
                if not len(b):
                    continue
                ids, x = b[id_col].to_numpy(), _matrix(b[vector])
                own = None if asked is None else (x @ centres.T).argmax(axis=1)
                m = min(k + 1, len(ids))  # one more, for the query itself
                for lo in range(0, len(q), 256):
                    part = q[lo : lo + 256]
                    if own is None:
                        s = part @ x.T
                    else:
                        s = np.full((len(part), len(x)), -np.inf)
                        for c in np.unique(own):
                            at = np.ix_(np.flatnonzero(asked[lo : lo + 256, c]), np.flatnonzero(own == c))
                            s[at] = part[at[0].ravel()] @ x[at[1].ravel()].T
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :m]
                    score = np.take_along_axis(s, order, 1).ravel()
                    made = pd.DataFrame({"query": np.repeat(names[lo : lo + 256], m), "id": ids[order].ravel(), "score": score})
                    yield made[np.isfinite(score)]

        part = rows.select(F.col(id_col), F.col(vector)).mapInPandas(run, "query long, id long, score double").filter("query <> id")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query long, id long, score double")
    return top_k(found, "query", "score", "id", k)


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((tables * bits, dim))


def lsh_keys(rows: DataFrame, id_col: str, vector: str, dim: int, tables: int, bits: int, seed: int = 1) -> DataFrame:
    """Rows (id, table, key): random-hyperplane buckets."""
    planes = _planes(dim, tables, bits, seed)

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 1024):  # few rows' planes at once
                some = b.iloc[lo : lo + 1024]
                x = np.array(some["vector"].tolist(), float).reshape(len(some), dim)
                sign = (x @ planes.T > 0).reshape(len(some), tables, bits)
                keys = (sign * (1 << np.arange(bits))).sum(axis=2)
                yield pd.DataFrame({"id": np.repeat(some["id"].to_numpy(), tables), "table": np.tile(np.arange(tables), len(some)), "key": keys.ravel()})

    src = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return src.mapInPandas(run, "id long, table int, key long")


def lsh_search(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, dim: int, k: int, tables: int = 8, bits: int | None = None, recall: float = RECALL) -> DataFrame:
    """Top-k with an expected recall of ``recall``: candidates share a bucket in some table; scores are exact.

    A row at cosine c meets the query in some table with probability
    1 - (1 - (1 - acos(c) / pi) ** bits) ** tables. A query for which that is less
    than ``recall`` at its k-th score, that met fewer than k rows, or that has a bucket
    of over ``BUCKET`` rows, is answered by exact search. Unless ``bits`` is given,
    it is 10 or, for buckets of a few rows however many there are, more.
    """
    if bits is None:
        bits = max(10, math.ceil(math.log2(max(rows.count(), 1) / 4)))
    keys = cut(lsh_keys(rows, id_col, vector, dim, tables, bits))
    asked = lsh_keys(queries, id_col, vector, dim, tables, bits).select(F.col("id").alias("query"), "table", "key")
    large = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
    busy = asked.join(large, ["table", "key"], "left_semi").select("query").distinct()
    pairs = asked.join(busy, "query", "left_anti").join(keys, ["table", "key"]).filter("query <> id").select("query", "id").distinct()
    pairs = pairs.join(queries.select(F.col(id_col).alias("query"), F.col(vector).alias("q")), "query").join(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "id")
    found = cut(top_k(pairs.select("query", "id", cosine(F.col("q"), F.col("v")).alias("score")), "query", "score", "id", k))
    angle = F.acos(F.least(F.greatest(F.min("score"), F.lit(-1.0)), F.lit(1.0)))
    meets = 1 - F.pow(1 - F.pow(1 - angle / np.pi, F.lit(bits)), F.lit(tables))
    sure = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), meets.alias("meets")).filter((F.col("n") == k) & (F.col("meets") >= recall)).select("query")
    left = queries.join(sure, queries[id_col] == sure["query"], "left_anti")
    return found.join(sure, "query", "left_semi").unionByName(dense_search(rows, left, id_col, vector, k))


def kmeans(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centres of unit vectors, seeded by the first rows; an empty list keeps its centre."""
    centres = sample[:lists].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def probes_for(x: np.ndarray, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists whose rows hold the share ``recall`` of the queries' top-k among ``x``, with two standard errors to spare.

    The top-k of a sample lies farther off than that of all rows, and so in no fewer lists.
    """
    if not len(x) or not len(q):
        return max(1, len(centres))
    s = np.where(asked[:, None] == ids, -np.inf, q @ x.T)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # a list's place in the query's order
    own = (x @ centres.T).argmax(axis=1)
    at = np.take_along_axis(place, own[top], 1)
    for p in range(1, len(centres)):
        share = (at < p).mean(axis=1)
        if share.mean() - 2 * share.std() / np.sqrt(len(share)) >= recall:
            return p
    return len(centres)


def ivf_search(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, lists: int = 32, probes: int | None = None, sample_rows: int = 5000, recall: float = RECALL) -> DataFrame:
    """Approximate top-k over cluster lists; with all lists probed the search is exact.

    Centres are fitted on the ``sample_rows`` rows of least hash; every row is indexed.
    Unless ``probes`` is given, it is the number with which a sample of the queries
    finds ``recall`` of its top-k among the sampled rows (``probes_for``).
    """
    sample = rows.orderBy(F.xxhash64(id_col)).limit(sample_rows).select(id_col, vector).toPandas()
    x = _matrix(sample[vector])
    centres = kmeans(x, min(lists, len(sample)))
    if probes is None:
        asked = queries.orderBy(F.xxhash64(id_col)).limit(PROBE_QUERIES).select(id_col, vector).toPandas()
        probes = probes_for(x, sample[id_col].to_numpy(), _matrix(asked[vector]), asked[id_col].to_numpy(), centres, k, recall)

    return _search(rows, queries, id_col, vector, k, centres, probes)


def bm25(counts: DataFrame, queries: DataFrame, n_docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows (query, id, score). ``counts``: (id, term, n, length); ``queries``: (query, term), repeated terms once; ``n_docs``: one row (docs, mean_length)."""
    asked = beside(queries.select("query", "term").distinct())
    # only terms that are asked for are counted over the documents
    counts = counts.join(beside(asked.select("term").distinct()), "term", "left_semi")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = asked.join(beside(df), "term").join(F.broadcast(n_docs), how="cross")  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return beside(q).join(counts, "term").groupBy("query", "id").agg(F.sum(weight).alias("score"))


def rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """Rows (query, id, score): sums of 1 / (k + rank) over rows (query, id, rank) of all lists."""
    return lists.groupBy("query", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query recall, precision, reciprocal rank, average precision and nDCG at k.

    ``ranked``: (query, id, rank); ``relevant``: (query, id).
    """
    n = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query", "id"], "left").fillna(0, ["hit"])
    upto = F.sum("hit").over(W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    h = hits.withColumn("seen", upto)
    per = h.groupBy("query").agg(
        F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("length"), F.coalesce(F.max(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("gains"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.join(n, "query").select(
        "query", (F.col("hits") / F.col("n_relevant")).alias("recall"), (F.col("hits") / F.least(F.lit(k), F.col("length"))).alias("precision"), "reciprocal_rank",
        (F.col("gains") / F.least(F.lit(k), F.col("n_relevant"))).alias("average_precision"), (F.col("dcg") / ideal).alias("ndcg"),
    )


def max_sim(a: Column, b: Column) -> Column:
    """Late interaction: the sum over query vectors of their best cosine with a document's vectors."""
    return F.aggregate(F.transform(a, lambda q: F.array_max(F.transform(b, lambda d: cosine(q, d)))), F.lit(0.0), lambda s, x: s + x)


def within_budget(ranked: DataFrame, length: str, budget: int) -> DataFrame:
    """Ranked chunks up to the first that exceeds the budget of characters; all lower ranks are dropped."""
    w = W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("upto", F.sum(length).over(w)).filter(F.col("upto") <= budget)


def recency(age: Column, half_life: float, kind: str = "exponential") -> Column:
    if kind == "none":
        return F.lit(1.0)
    if kind == "linear":
        return F.least(F.greatest(1.0 - age / (2 * half_life), F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(F.pow(F.lit(0.5), age / half_life), F.lit(0.0)), F.lit(1.0))


def bounded_memory(items: DataFrame, keys: list[str], importance: str, age: str, id_col: str, capacity: int, half_life: float) -> DataFrame:
    """The ``capacity`` items of each key with the most importance plus recency; equal ones go from the smallest id."""
    w = W.partitionBy(*keys).orderBy((F.col(importance) + recency(F.col(age), half_life)).desc(), F.col(id_col).desc())
    return items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= capacity).drop("_r")
