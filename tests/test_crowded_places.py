"""Neighbours and approaches where many share a place."""

from heliograin.operators import flows, signal


def test_neighbours_of_crowded_places(spark):
    rows = [(k, float(k * 7 % 5), float(k * 3 % 4)) for k in range(70)] + [(100 + k, 30.0 + k / 3, 30.0) for k in range(6)] + [(900, None, 1.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    got = sorted(map(tuple, flows.grid_neighbours(p, p, "x", "y", 2.0, 3, "id").collect()))
    want = []
    for i, x, y in rows:
        near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in rows if j != i and None not in (x, u))
        want += [(i, j, d, r) for r, (d, j) in enumerate([n for n in near if n[0] <= 2.0][:3], 1)]
    assert [(a, b, round(d, 9), r) for a, b, d, r in got] == [(a, b, round(d, 9), r) for a, b, d, r in sorted(want)]


def test_pairs_of_points_of_one_place_are_not_made(spark):
    p = spark.range(120_000).selectExpr("id", "cast(id % 2 as double) as x", "0.0D as y")  # 14 thousand million pairs
    found = flows.grid_neighbours(p, p, "x", "y", 8.0, 4, "id")
    assert found.count() == 480_000


def test_approaches_in_parts(spark, monkeypatch):
    ships = spark.range(60).selectExpr("id % 2 as t", "id", "cast(id * 37 % 50 as double) as x", "cast(id * 53 % 50 as double) as y", "cast(id % 7 - 3 as double) as vx", "cast(id % 5 - 2 as double) as vy")
    call = lambda: sorted(map(tuple, signal.closest_approach(ships, "t", "id", "x", "y", "vx", "vy", 20.0).collect()))
    whole = call()
    monkeypatch.setattr(signal, "SHIPS", 2)
    assert call() == whole and len({r[:3] for r in whole}) == len(whole) > 0
