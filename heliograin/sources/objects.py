"""A content-addressed table of objects, named references to them, and what no reference reaches.

An object's key is the SHA-256 of its bytes. Objects lie in folders by the key's
first PREFIX hex digits, so a reader of some keys opens the folders of those alone. Putting is
idempotent: equal contents are one object, and only objects that aren't there are written.
References (name, digest, at) are appended; a name's latest one counts, among equals the greatest digest.

Defined results: a null content is no object; putting nothing writes nothing; an absent table reads as empty.
One writer at a time: two that put the same new object at once would both write it, which ``objects`` reads as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from heliograin.operators import graph

PREFIX = 2
_OBJECTS = "digest string, size long, content binary, prefix string"
_REFS = "name string, digest string, at long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def addressed(df: DataFrame, content: str) -> DataFrame:
    """Rows (digest, size, content, prefix), one for each distinct content; the same digest is the same content."""
    bytes_ = F.col(content).cast("binary")
    made = df.filter(F.col(content).isNotNull()).select(F.sha2(bytes_, 256).alias("digest"), F.octet_length(bytes_).cast("long").alias("size"), bytes_.alias("content"))
    return made.dropDuplicates(["digest"]).withColumn("prefix", F.substring("digest", 1, PREFIX))


def put(df: DataFrame, content: str, path: str) -> None:
    """Adds the contents that aren't there yet."""
    known = _read(df.sparkSession, f"{path}/objects", _OBJECTS).select("prefix", "digest")
    fresh = addressed(df, content).join(known, ["prefix", "digest"], "left_anti")
    # rows of a folder come together, so that each task writes few files
    fresh.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{path}/objects")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Rows (digest, size, content, prefix)."""
    return _read(spark, f"{path}/objects", _OBJECTS).dropDuplicates(["digest"])


def get(spark: SparkSession, path: str, digests: list[str]) -> DataFrame:
    """The objects of some keys, read from their folders only."""
    prefixes = sorted({d[:PREFIX] for d in digests})
    return _read(spark, f"{path}/objects", _OBJECTS).filter(F.col("prefix").isin(prefixes) & F.col("digest").isin(digests)).dropDuplicates(["digest"])


def intact(found: DataFrame) -> DataFrame:
    """Rows (digest, intact): whether the content still has the digest it is stored under."""
    return found.select("digest", (F.sha2("content", 256) == F.col("digest")).alias("intact"))


def set_refs(refs: DataFrame, path: str) -> None:
    """Appends references (name, digest, at)."""
    refs.select("name", "digest", F.col("at").cast("long").alias("at")).write.mode("append").parquet(f"{path}/refs")


def refs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, digest): each name's latest reference."""
    return _read(spark, f"{path}/refs", _REFS).groupBy("name").agg(F.max_by("digest", F.struct("at", "digest")).alias("digest"))


def unreferenced(spark: SparkSession, path: str, links: DataFrame) -> DataFrame:
    """Keys of objects that no name reaches over ``links`` (src, dst) between digests."""
    held = objects(spark, path).select(F.col("digest").alias("node"))
    return graph.unreachable(held, links, refs(spark, path).select(F.col("digest").alias("node")).distinct())
