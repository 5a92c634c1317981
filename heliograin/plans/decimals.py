"""Exact decimal queries over orders."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from heliograin.operators import decimals
from heliograin.plans.base import query, table

PRICE = "o_totalprice::DECIMAL(14,2)"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(14,2)").alias("p"), ((F.col("o_custkey") % 12).cast("decimal(9,7)") / 100).cast("decimal(9,7)").alias("r"))


# all amounts are told in cents
@query(
    f"WITH o AS (SELECT o_orderkey, ({PRICE} * 100)::HUGEINT AS c, (o_custkey % 12)::HUGEINT AS r FROM orders) SELECT o_orderkey, ((c * r * 2 + 1200) // 2400)::BIGINT AS rounded, (c * r // 1200)::BIGINT AS truncated, (c + (c * r * 2 + 1200) // 2400)::BIGINT AS balance FROM o"
)
def decimals_accrue(spark, d):
    a = _orders(spark, d).select("o_orderkey", decimals.accrue(F.col("p"), F.col("r")).alias("a"))
    return a.select("o_orderkey", *[(F.col(f"a.{c}") * 100).cast("long").alias(c) for c in ("rounded", "truncated", "balance")])


DAYS = """CASE WHEN s_day = 31 OR (month(s) = 2 AND last_day(s) = s) THEN 30 ELSE s_day END AS d1, CASE WHEN month(s) = 2 AND last_day(s) = s AND month(e) = 2 AND last_day(e) = e THEN 30 WHEN e_day = 31 AND (s_day >= 30 OR (month(s) = 2 AND last_day(s) = s)) THEN 30 ELSE e_day END AS d2"""


@query(
    f"WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_custkey % 400)::INT)::DATE AS e FROM orders), p AS (SELECT *, day(s) AS s_day, day(e) AS e_day FROM o), q AS (SELECT *, {DAYS} FROM p) SELECT o_orderkey, (360 * (year(e) - year(s)) + 30 * (month(e) - month(s)) + d2 - d1)::INT AS days FROM q"
)
def decimals_days_30_360(spark, d):
    o = _orders(spark, d).withColumn("s", F.col("o_orderdate").cast("date"))
    o = o.withColumn("e", F.date_add("s", (F.col("o_custkey") % 400).cast("int")))
    return o.select("o_orderkey", decimals.days_30_360(F.col("s"), F.col("e")).cast("int").alias("days"))


@query(
    f"WITH o AS (SELECT o_orderkey, ({PRICE} * 100)::HUGEINT AS c FROM orders), t AS (SELECT o_orderkey, c, least(c, 5000000) * 10 + greatest(least(c, 15000000) - 5000000, 0) * 20 + greatest(c - 15000000, 0) * 32 AS t, CASE WHEN c >= 15000000 THEN 32 WHEN c >= 5000000 THEN 20 ELSE 10 END AS top FROM o) "
    "SELECT o_orderkey, ((t + 50) // 100)::BIGINT AS bracket, ((c * top + 50) // 100)::BIGINT AS flat FROM t"
)
def decimals_bracket_tax(spark, d):
    brackets = [(Decimal("0"), Decimal("0.10")), (Decimal("50000"), Decimal("0.20")), (Decimal("150000"), Decimal("0.32"))]
    o = _orders(spark, d)
    return o.select("o_orderkey", (decimals.bracket_tax(F.col("p"), brackets) * 100).cast("long").alias("bracket"), (decimals.flat_top_tax(F.col("p"), brackets) * 100).cast("long").alias("flat"))


@query(
    f"WITH r(code, rate) AS (VALUES (0, 100000000::HUGEINT), (1, 195583000::HUGEINT), (2, 655957000::HUGEINT), (3, 88273000::HUGEINT)), o AS (SELECT o_orderkey, ({PRICE} * 100)::HUGEINT AS c, o_custkey % 4 AS s, o_orderkey % 4 AS t FROM orders), "
    "e AS (SELECT o_orderkey, (c * 1000000000000 * 2 + a.rate) // (2 * a.rate) AS micro, b.rate AS rt FROM o JOIN r a ON a.code = s JOIN r b ON b.code = t) SELECT o_orderkey, ((micro * rt * 2 + 1000000000000) // 2000000000000)::BIGINT AS converted FROM e"
)
def decimals_convert(spark, d):
    rates = spark.createDataFrame([(0, Decimal("1.00000000")), (1, Decimal("1.95583000")), (2, Decimal("6.55957000")), (3, Decimal("0.88273000"))], "code long, rate decimal(16,8)")
    o = _orders(spark, d).select("o_orderkey", F.col("p").cast("decimal(16,4)").alias("p"), (F.col("o_custkey") % 4).alias("s"), (F.col("o_orderkey") % 4).alias("t"))
    return decimals.convert_with(o, rates, "p", "s", "t").select("o_orderkey", (F.col("converted") * 100).cast("long").alias("converted"))


@query("SELECT c_custkey AS id, 12 AS periods, 0.0::DOUBLE AS final, (c_custkey + 1) * 100000 AS repaid FROM customer")
def decimals_amortize(spark, d):
    loans = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") + 1) * 1000).cast("decimal(18,2)").alias("p"), F.lit(Decimal("0.01")).alias("r"), F.lit(12).alias("n"))
    s = decimals.amortize(loans, "c_custkey", "p", "r", "n")
    return s.groupBy("id").agg(F.max("period").alias("periods"), F.min("balance").cast("double").alias("final"), (F.sum("principal") * 100).cast("long").alias("repaid"))


@query(f"SELECT o_orderkey, ({PRICE} * 100)::BIGINT AS cents, o_custkey % 4 = 0 AS exact FROM orders")
def decimals_fixed_point(spark, d):
    o = _orders(spark, d)
    quarter = F.col("o_custkey").cast("decimal(18,4)") / 4
    return o.select("o_orderkey", (decimals.fixed_point(F.col("p"), 11, 2) * 100).cast("long").alias("cents"), decimals.is_representable(quarter, 0).alias("exact"))
