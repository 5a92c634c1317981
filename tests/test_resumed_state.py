"""Detector state: a stream stopped and restarted, one seeded from a batch table, states read from a checkpoint."""

import random

import pytest

from heliograin.streaming import kernels as K

SCHEMA = "k string, i long, x double"


def rows(seed=1, n=90):
    rng = random.Random(seed)
    return [(rng.choice("abc"), i, rng.uniform(0, 10)) for i in range(n)]


def write(spark, folder, name, some):
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def streamed(spark, folder, kernel, checkpoint, start=None):
    """Runs what is new under the folder and stops."""
    got = []
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")
    made = K.in_stream(stream, "k", "i", "x", kernel, start)
    query = made.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return got


def batch(spark, some, kernel, start=None):
    return sorted(tuple(r) for r in K.in_batch(spark.createDataFrame(some, SCHEMA), "k", ["i"], "x", kernel, ["i"], start=start).collect())


@pytest.mark.parametrize("kernel", [K.ema(0.2), K.cusum(5.0, 0.5, 6.0), K.rsi(4)], ids=["ema", "cusum", "rsi"])
def test_stopped_restarted_and_seeded_streams_equal_the_batch(spark, tmp_path, kernel):
    every = rows()
    want = batch(spark, every, kernel)
    write(spark, f"{tmp_path}/in", "one", every[:40])
    first = streamed(spark, f"{tmp_path}/in", kernel, f"{tmp_path}/checkpoint")
    # states of the stopped query, as a table
    saved = {r.k: r.state for r in K.saved_states(spark, f"{tmp_path}/checkpoint", "k").collect()}
    table = K.states_after(spark.createDataFrame(every[:40], SCHEMA), "k", ["i"], "x", kernel)
    assert saved == {r.k: r.state for r in table.collect()}
    # the same query restarted
    write(spark, f"{tmp_path}/in", "two", every[40:])
    second = streamed(spark, f"{tmp_path}/in", kernel, f"{tmp_path}/checkpoint")
    assert sorted(first + second) == want
    # a new query seeded from the table
    table.write.parquet(f"{tmp_path}/states")
    write(spark, f"{tmp_path}/late", "two", every[40:])
    seeded = streamed(spark, f"{tmp_path}/late", kernel, f"{tmp_path}/other", spark.read.parquet(f"{tmp_path}/states"))
    assert sorted(seeded) == sorted(second)
    assert sorted(batch(spark, every[:40], kernel) + batch(spark, every[40:], kernel, spark.read.parquet(f"{tmp_path}/states"))) == want


def test_states_of_keys_without_new_rows_and_of_new_keys(spark):
    kernel = K.ema(0.5)
    start = spark.createDataFrame([("old", "[4.0]"), (None, "[2.0]")], "k string, state string")
    some = spark.createDataFrame([("new", 1, 3.0), (None, 1, 6.0), ("new", 2, None)], SCHEMA)
    got = {r.k: r.state for r in K.states_after(some, "k", ["i"], "x", kernel, start).collect()}
    assert got == {"old": "[4.0]", "new": "[3.0]", None: "[4.0]"}
    assert K.in_batch(some.limit(0), "k", ["i"], "x", kernel, ["i"], start=start).count() == 0
