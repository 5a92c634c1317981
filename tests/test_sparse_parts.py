"""Normal equations by summed products of short rows and by long rows as they are."""

import numpy as np
import pytest

from heliograin.operators import sparse


@pytest.mark.parametrize("long", [0, 3])
def test_short_and_long_rows(spark, long):
    rng = np.random.default_rng(5)
    h = np.zeros((60 + long, 24))
    for r in range(60):
        h[r, rng.choice(24, 3, replace=False)] = rng.normal(size=3)
    h[:24] += np.eye(24) * 3
    h[60:] = rng.normal(size=(long, 24))  # longer than SHORT
    z = rng.normal(size=len(h))
    entries = spark.createDataFrame([(int(r), int(c), float(h[r, c])) for r, c in zip(*np.nonzero(h))], "row long, col long, v double")
    measured = spark.createDataFrame([(r, float(v), 0.5 + r % 2) for r, v in enumerate(z)], "row long, z double, sigma double")
    w = 1 / (0.5 + np.arange(len(h)) % 2) ** 2
    weights = measured.selectExpr("row", "1 / sigma / sigma as weight")
    g, rest = sparse.normal_parts(entries, weights)
    short = h[:60] * np.sqrt(w[:60])[:, None]
    got = np.zeros((24, 24))
    for r in g.collect():
        got[r["to"], r["col"]] += r["g"]
    assert np.allclose(got, short.T @ short) and (rest is not None) == (long > 0)
    found, _ = sparse.least_squares(entries, measured)
    x = np.linalg.solve(h.T @ (w[:, None] * h), h.T @ (w * z))
    assert np.allclose([r["x"] for r in found.orderBy("col").collect()], x)
