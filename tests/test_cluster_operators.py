"""Transforms, sparse least squares, objects, flood history and numbers against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograin.operators import flows, fourier, frame, graph, sparse
from heliograin.plans import cluster
from heliograin.sources import objects


@pytest.mark.parametrize("n, most", [(1, 99), (2, 99), (12, 99), (97, 99), (97, 4), (360, 99), (262, 16)])
def test_transform_equals_the_plain_one(spark, n, most):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n) + 1j * rng.normal(size=n), rng.normal(size=max(1, n // 2))
    rows = [("x", i, float(v.real), float(v.imag)) for i, v in enumerate(x)] + [(None, i, float(v), None) for i, v in enumerate(y)]
    got = fourier.transform(spark.createDataFrame(rows, "k string, i int, re double, im double"), "k", "i", "re", "im", most_points=most).collect()
    for key, want in (("x", np.fft.fft(x)), (None, np.fft.fft(y))):
        mine = sorted((r.bin, r.re, r.im) for r in got if r.k == key)
        assert [b for b, *_ in mine] == list(range(len(want)))
        assert np.allclose([a + 1j * b for _, a, b in mine], want, atol=1e-8 * max(1, n))


def test_parseval_of_a_long_series(spark):
    n = 1 << 18
    rows = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("i"), F.rand(5).alias("x")).cache()
    sums = fourier.transform(rows, "k", "i", "x").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("e"), F.count(F.lit(1)).alias("n")).first()
    energy = rows.agg(F.sum(F.col("x") ** 2)).first()[0]
    assert sums.n == n and sums.e / n == pytest.approx(energy, rel=1e-9)


def test_transform_of_nothing(spark):
    assert fourier.transform(spark.createDataFrame([], "k string, i int, x double"), "k", "i", "x").count() == 0


def dense(h, z, sigma, rows, cols):
    m = np.zeros((rows, cols))
    for r, c, v in h:
        m[r, c] += v
    w = 1 / np.array(sigma) ** 2
    g = m.T @ (m * w[:, None])
    x = np.linalg.solve(g, m.T @ (w * z))
    r = z - m @ x
    omega = 1 / w - np.einsum("ij,jk,ik->i", m, np.linalg.inv(g), m)
    return x, r, r**2 @ w, np.abs(r) / np.sqrt(omega)


def test_least_squares_and_the_bad_measurement(spark):
    rng = np.random.default_rng(2)
    rows, cols = 60, 12
    h = [(r, int(c), float(rng.normal())) for r in range(rows) for c in rng.choice(cols, 3, replace=False)]
    sigma = rng.uniform(0.05, 0.3, rows)
    m = np.zeros((rows, cols))
    for r, c, v in h:
        m[r, c] += v
    z = m @ rng.normal(size=cols) + sigma * rng.normal(size=rows)
    z[17] += 9
    x, r, objective, normal = dense(h, z, sigma, rows, cols)
    entries = spark.createDataFrame([*h, (3, 4, None)], "row long, col long, v double")
    measured = spark.createDataFrame([(i, float(z[i]), float(sigma[i])) for i in range(rows)] + [(99, None, 1.0), (98, 1.0, 0.0)], "row long, z double, sigma double")
    found, left = sparse.least_squares(entries, measured)
    assert np.allclose([v.x for v in sorted(found.collect(), key=lambda v: v.col)], x, atol=1e-8)
    assert np.allclose([v.residual for v in sorted(left.collect(), key=lambda v: v.row)], r, atol=1e-8)
    chi = sparse.chi_square(left, found).first()
    assert chi.dof == rows - cols and chi.objective == pytest.approx(objective)
    some = left.orderBy(F.desc(F.col("residual") ** 2 * F.col("weight"))).limit(6)
    told = {v.row: v.normalized for v in sparse.normalized_residuals(entries, left, some.select("row")).collect()}
    assert len(told) == 6 and all(v == pytest.approx(normal[k], rel=1e-6) for k, v in told.items())
    assert max(told, key=told.get) == 17


def test_planted_measurement_is_named(spark, data):
    first = spark.read.parquet(f"{data}/lineitem.parquet").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).first()[0]
    (row,) = cluster.fitting_bad_measurement(spark, data).collect()
    assert row.row == first and row.normalized > 100
    h, measured = cluster._grid(spark, data)
    e, z = h.collect(), {r.row: r.z for r in measured.collect()}
    place = {k: i for i, k in enumerate(sorted(z))}
    x, *_ = dense([(place[r.row], r.col, r.v) for r in e], np.array([z[k] for k in sorted(z)]), [0.1] * len(z), len(z), 12)
    assert [r.x for r in sorted(cluster.fitting_sparse_levels(spark, data).collect(), key=lambda r: r.col)] == pytest.approx(x.tolist(), abs=2e-6)


def test_objects(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert objects.objects(spark, path).count() == 0 and objects.refs(spark, path).count() == 0
    put = lambda *texts: objects.put(spark.createDataFrame([(t,) for t in texts], "text string"), "text", path)
    put("a", "b", "b", None, "")
    files = sorted(p.name for p in tmp_path.glob("store/objects/*/*.parquet"))
    put("b", "a")
    assert sorted(p.name for p in tmp_path.glob("store/objects/*/*.parquet")) == files  # put twice is put once
    put("c", "a")
    held = {bytes(r.content).decode(): r.digest for r in objects.objects(spark, path).collect()}
    assert set(held) == {"a", "b", "c", ""}
    asked = objects.get(spark, path, [held["a"], held["c"], "00" * 32])
    assert {r.digest for r in asked.collect()} == {held["a"], held["c"]}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or "PartitionFilters: [prefix" in plan
    assert all(r.intact for r in objects.intact(objects.objects(spark, path)).collect())
    objects.set_refs(spark.createDataFrame([("main", held["a"], 1), ("main", held["b"], 2), ("old", held["a"], 5)], "name string, digest string, at long"), path)
    assert {(r.name, r.digest) for r in objects.refs(spark, path).collect()} == {("main", held["b"]), ("old", held["a"])}
    links = spark.createDataFrame([(held["b"], held["c"])], "src string, dst string")
    assert [r.node for r in objects.unreferenced(spark, path, links).collect()] == [held[""]]


def test_flood_history_does_not_stop_at_blocks(spark, monkeypatch):
    monkeypatch.setattr(flows, "FLOOD_BLOCK", 7)
    rows = [(k, "s", "d", 1, 80, 100 if k % 20 else 1000, 0, 10, 10, float(k), float(k), 0, 0, 0, 1.0) for k in range(1, 90)]
    names = "w long, src_ip string, dst_ip string, src_port long, dst_port int, bytes_out long, bytes_in long, packets_out long, packets_in long, start_time double, end_time double, syn_count int, rst_count int, error_count int, avg_payload_size double"
    got = sorted(int(r.target) for r in flows.floods(spark.createDataFrame(rows, names), "w").collect())
    assert got == [20, 40, 60, 80]


def test_numbers_and_reached_nodes(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x")).repartition(6)
    assert [r["rank"] for r in frame.numbered(df, [F.col("x").desc()]).orderBy(F.desc("x")).collect()] == list(range(500))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 0), (100, 101)], "src long, dst long")
    starts = spark.createDataFrame([(30,), (35,), (35,)], "node long")
    assert sorted(r.node for r in graph.reached(edges, starts).collect()) == list(range(30, 41))
    assert graph.reachable(edges, starts).count() == 11 + 6
