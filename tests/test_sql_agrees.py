"""Queries and their SQL on values where rounding decides."""

import datetime

import duckdb
import pytest

from heliograin import catalog
from heliograin.operators import flows


def both(spark, folder, name, tables):
    for t, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    found = c.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(k) for k in got.columns]
    return sorted(map(tuple, got.collect()), key=str), sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)


def test_run_length_at_the_allowed_shift(spark, tmp_path):
    balances = [2500.0, -2500.0, 2500.01, 2499.99, 2500.07, -2499.98, 2600.0, 2547.9, 2548.5, 0.0, 9999.99, -999.99]
    s = spark.createDataFrame([(k, v) for k, v in enumerate(balances)], "s_suppkey long, s_acctbal double")
    got, want = both(spark, tmp_path, "fitting_run_length", {"supplier": s})
    assert got == want and dict(got)[0] == pytest.approx(26.6876, abs=0.1)


def test_cusum_whose_sum_is_the_threshold(spark, tmp_path):
    rows = [(u, v) for u, xs in enumerate([[18.07, 11.93], [27.13, 2.87, 0.0], [26.99, 3.01], [100.0, 70.0, 1.0]]) for v in xs]
    start = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(k, start + datetime.timedelta(seconds=k), u, "view", v, "") for k, (u, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got, want = both(spark, tmp_path, "state_cusum", {"events": e})
    assert got == want and {r[-1] for r in got if r[0] == 0} == {0.0}


def test_half_of_a_last_digit_is_rounded_up(spark):
    confidence = [0.5 + 0.3 * (k / 240) + 0.2 for k in range(1, 240)]
    rows = spark.createDataFrame([("d", None, "t", "k", v) for v in confidence], "detector string, source string, target string, kind string, confidence double")
    got = [r["line"].split('"confidence":')[1].split(",")[0] for r in flows.event_lines(rows).collect()]
    want = duckdb.sql("SELECT round(0.7::DECIMAL(18, 9) + k * 0.00125::DECIMAL(18, 9), 4)::DOUBLE::VARCHAR FROM range(1, 240) t(k) ORDER BY k").fetchall()
    assert got == [x[0] for x in want]
