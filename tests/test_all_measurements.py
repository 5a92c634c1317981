"""The bad measurement is looked for among all, not among those that are farthest off."""

import numpy as np
import pytest

from heliograin.operators import sparse
from heliograin.plans import cluster
from test_cluster_operators import dense


def of_grid(spark, data):
    """Each measurement's normalised residual, by plain numpy."""
    h, measured = cluster._grid(spark, data)
    e, z = h.collect(), {r.row: r.z for r in measured.collect()}
    rows = sorted(z)
    place = {k: i for i, k in enumerate(rows)}
    normal = dense([(place[r.row], r.col, r.v) for r in e], np.array([z[k] for k in rows]), [0.1] * len(z), len(z), 12)[3]
    return dict(zip(rows, normal))


def test_a_bad_measurement_of_a_rare_level_is_found(spark, tmp_path):
    # many are far off where many measure the same; one, less far off, is of a level that hardly any other tells about
    rows = [(k + 1, s, p, 0.0) for k, (s, p) in enumerate([(s, p) for s in range(6) for p in range(5)] * 20)]
    rows = [(k, s, p, 44.0 if 100 <= k < 112 else 0.0) for k, s, p, _ in rows] + [(700, 6, 0, 62.0), (701, 6, 1, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_discount double").selectExpr("*", "1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = of_grid(spark, str(tmp_path))
    (row,) = cluster.fitting_bad_measurement(spark, str(tmp_path)).collect()
    assert row.row == max(want, key=want.get) == 7001
    assert row.normalized == pytest.approx(want[7001], abs=2e-4)


@pytest.mark.parametrize("short, block", [(16, 5), (2, 64)])
def test_every_measurement_has_its_residual(spark, monkeypatch, short, block):
    monkeypatch.setattr(sparse, "SHORT", short)
    monkeypatch.setattr(sparse, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows, cols = 40, 6
    kinds = [[(int(c), float(rng.normal())) for c in rng.choice(cols, int(rng.integers(1, 5)), replace=False)] for _ in range(15)]
    picks = [kinds[k % 15] for k in range(rows)]
    h = [(r, c, v) for r, line in enumerate(picks) for c, v in line]
    sigma, z = rng.uniform(0.05, 0.3, rows), rng.normal(size=rows)
    *_, normal = dense(h, z, sigma, rows, cols)
    entries = spark.createDataFrame(h, "row long, col long, v double")
    measured = spark.createDataFrame([(i, float(z[i]), float(sigma[i])) for i in range(rows)] + [(99, 1.0, 1.0)], "row long, z double, sigma double")
    left = sparse.least_squares(entries, measured)[1]
    told = {r.row: r.normalized for r in sparse.normalized_residuals(entries, left).collect()}
    assert sorted(told) == list(range(rows)) and [told[r] for r in range(rows)] == pytest.approx(normal.tolist(), rel=1e-6)
    few = sparse.normalized_residuals(entries, left, left.filter("row in (3, 30)").select("row")).collect()
    assert {r.row: r.normalized for r in few} == pytest.approx({3: normal[3], 30: normal[30]}, rel=1e-6)
