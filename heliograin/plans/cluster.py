"""Objects by content, whole spectra, and sparse least squares."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.operators import fourier, sparse
from heliograin.plans.base import CANDLES, candles, query, rounded, table
from heliograin.sources import objects, scratch

DIGESTS = "d AS (SELECT doc_id, source, text, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)"
REFS = "refs AS (SELECT source AS name, arg_max(digest, doc_id) AS digest FROM d GROUP BY source)"


def _store(spark, d):
    """The texts of documents, put twice, and a reference for each source to its last document."""
    docs, path = table(spark, d, "documents").filter("text is not null"), scratch.new_path(spark, "objects")
    objects.put(docs.filter("doc_id % 3 > 0"), "text", path)
    objects.put(docs, "text", path)
    objects.set_refs(docs.select(F.col("source").alias("name"), F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("at")), path)
    return path


@query(f"WITH {DIGESTS} SELECT DISTINCT digest, strlen(text)::BIGINT AS size, true AS intact FROM d")
def source_objects(spark, d):
    found = objects.objects(spark, _store(spark, d))
    return found.select("digest", "size").join(objects.intact(found), "digest")


@query(f"WITH {DIGESTS}, {REFS} SELECT name, digest FROM refs")
def source_object_refs(spark, d):
    return objects.refs(spark, _store(spark, d))


@query(
    f"WITH RECURSIVE {DIGESTS}, {REFS}, links AS (SELECT a.digest AS src, b.digest AS dst FROM d a JOIN d b ON b.doc_id = 2 * a.doc_id AND a.doc_id <> b.doc_id), up AS (SELECT digest FROM refs UNION SELECT dst FROM up JOIN links ON src = digest) "
    "SELECT DISTINCT digest AS node FROM d WHERE digest NOT IN (SELECT digest FROM up)"
)
def source_objects_unreferenced(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("dst"))
    above = docs.select(F.col("doc_id").alias("_above"), F.col("dst").alias("src"))
    links = docs.join(above, (F.col("doc_id") == 2 * F.col("_above")) & (F.col("doc_id") != F.col("_above"))).select("src", "dst")
    return objects.unreferenced(spark, _store(spark, d), links.filter("src is not null"))


@query(
    f"WITH {CANDLES}, s AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles), b AS (SELECT DISTINCT symbol, i AS bin FROM s) "
    "SELECT symbol, bin, round((sum(close * cos(2 * pi() * ((bin * i) % n) / n)) ** 2 + sum(close * sin(2 * pi() * ((bin * i) % n) / n)) ** 2) / any_value(n) / 1e6, 2) AS power FROM s JOIN b USING (symbol) GROUP BY ALL"
)
def fourier_spectrum(spark, d):
    """Every bin of each symbol's closing prices, by four steps."""
    rows = candles(spark, d).withColumn("i", F.row_number().over(W.partitionBy("symbol").orderBy("day")) - 1)
    bins = fourier.power(fourier.transform(rows, "symbol", "i", "close"), rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol")
    return rounded(bins.withColumn("power", F.col("power") / 1e6), 2)


# Line items measure the sum of a part and a supplier level; one direct measurement of each level keeps the system determined.


def _grid(spark, d):
    li = table(spark, d, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    li = li.groupBy("row").agg(F.min(F.struct("l_suppkey", "l_partkey", "l_discount")).alias("m")).select("row", "m.*")
    li = li.crossJoin(F.broadcast(li.agg(F.min("row").alias("_bad"))))  # one row
    z = (F.col("l_suppkey") % 7) * 2.0 + F.col("l_partkey") % 5 + F.col("l_discount") + F.when(F.col("row") == F.col("_bad"), 40).otherwise(0)
    li = li.select("row", F.array(F.col("l_suppkey") % 7, 7 + F.col("l_partkey") % 5).alias("cols"), z.alias("z"))
    anchors = spark.range(12).select((-F.col("id") - 1).alias("row"), F.array("id").alias("cols"), F.col("id").cast("double").alias("z"))
    rows = scratch.cut(li.unionByName(anchors))
    return rows.select("row", F.explode("cols").alias("col"), F.lit(1.0).alias("v")), rows.select("row", "z", F.lit(0.1).alias("sigma"))


@query()
def fitting_sparse_levels(spark, d):
    """Levels that the measurements give, by conjugate gradients."""
    return rounded(sparse.least_squares(*_grid(spark, d))[0], 6)


@query()
def fitting_bad_measurement(spark, d):
    """The measurement of largest normalised residual of all, which is the planted one unless another is farther off."""
    h, measured = _grid(spark, d)
    _, left = sparse.least_squares(h, measured)
    return rounded(sparse.normalized_residuals(h, left).orderBy(F.desc("normalized"), "row").limit(1))
