"""Registration of queries, and the views that several of them share, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograin.operators import market

QUERIES = {}
ORACLE_SQL = {}


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql=None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles of a result at a fixed number of digits."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def events(spark, d) -> DataFrame:
    """events with t, seconds since 1970."""
    return table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


EVENTS = "events_t AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


def candles(spark, d) -> DataFrame:
    """Daily candles of order prices by priority: symbol, day, open, high, low, close, volume."""
    o = table(spark, d, "orders").withColumn("symbol", F.col("o_orderpriority"))
    c = market.candles(o, ["symbol"], F.datediff("o_orderdate", F.lit("1970-01-01")), "o_totalprice", (F.col("o_custkey") % 100).cast("double"), ["o_orderkey"])
    return c.withColumnRenamed("bucket", "day").withColumn("day", F.col("day").cast("long"))


CANDLES = """candles AS (
  SELECT o_orderpriority AS symbol, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum((o_custkey % 100)::DOUBLE) AS volume FROM orders GROUP BY ALL)"""


def flows(spark, d) -> DataFrame:
    """Flow records made of line items."""
    li = table(spark, d, "lineitem")
    start = F.datediff("l_shipdate", F.lit("1970-01-01")) * 86400.0 + F.col("l_linenumber")
    ports = F.array(*map(F.lit, (22, 53, 80, 443, 3389, 8080, 25)))
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 40).alias("src_ip"), F.concat(F.lit("d"), F.col("l_partkey") % 20).alias("dst_ip"),
        (F.col("l_orderkey") % 60000 + 1024).alias("src_port"), F.element_at(ports, (F.col("l_linenumber") - 1) % 7 + 1).alias("dst_port"),
        (F.col("l_quantity") * 100).cast("long").alias("bytes_out"), F.floor("l_extendedprice").alias("bytes_in"), F.col("l_quantity").cast("long").alias("packets_out"), F.lit(3).cast("long").alias("packets_in"),
        start.alias("start_time"), (start + F.col("l_tax") * 100).alias("end_time"), F.col("l_linenumber").alias("syn_count"), (F.col("l_returnflag") == "R").cast("int").alias("rst_count"),
        (F.col("l_linestatus") == "O").cast("int").alias("error_count"), F.col("l_quantity").cast("double").alias("avg_payload_size"),
    )


FLOWS = """flows AS (
  SELECT 's' || (l_suppkey % 40) AS src_ip, 'd' || (l_partkey % 20) AS dst_ip, l_orderkey % 60000 + 1024 AS src_port, [22, 53, 80, 443, 3389, 8080, 25][(l_linenumber - 1) % 7 + 1] AS dst_port,
    trunc(l_quantity * 100)::BIGINT AS bytes_out, floor(l_extendedprice)::BIGINT AS bytes_in, trunc(l_quantity)::BIGINT AS packets_out, 3 AS packets_in,
    date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 86400.0::DOUBLE + l_linenumber AS start_time,
    date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 86400.0::DOUBLE + l_linenumber + l_tax * 100 AS end_time,
    l_linenumber AS syn_count, (l_returnflag = 'R')::INT AS rst_count, (l_linestatus = 'O')::INT AS error_count, l_quantity::DOUBLE AS avg_payload_size FROM lineitem)"""
