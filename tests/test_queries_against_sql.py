"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from heliograin import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, sql, name):
    got = catalog.QUERIES[name](spark, data)
    rows = plain(got.collect(), got.columns)
    if name in catalog.ORACLE_SQL:
        found = sql.execute(catalog.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(got.columns)
        assert rows == plain(found.fetchall(), names)
    else:
        assert rows or name.startswith("text_minhash")


NATIVE = [n for n in catalog.QUERIES if n.split("_")[0] in ("tabular", "stats", "series", "market", "flows", "datasets", "signal") and n not in ("series_nearest_step",)]


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_plan_has_no_python(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalog.QUERIES["tabular_flagship"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_discount,0.05)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
