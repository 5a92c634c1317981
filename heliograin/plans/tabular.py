"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import frame
from heliograin.plans.base import events, query, rounded, table
from heliograin.sources import files
from heliograin.sources.scratch import new_path


@query(
    "SELECT c_mktsegment, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey "
    "JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_discount > 0.05 GROUP BY ALL"
)
def tabular_flagship(spark, d):
    li = table(spark, d, "lineitem").filter("l_discount > 0.05").select("l_orderkey", "l_extendedprice", "l_discount")
    o, c, n = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean, count(l_quantity)::DOUBLE AS l_quantity_count, min(l_quantity)::DOUBLE AS l_quantity_min, max(l_quantity)::DOUBLE AS l_quantity_max FROM lineitem GROUP BY ALL")
def tabular_group_agg(spark, d):
    return rounded(frame.group_by_agg(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", ["sum", "mean", "count", "min", "max"]))


@query("SELECT count(*) AS n_rows, 6 AS n_cols FROM orders")
def tabular_shape(spark, d):
    return frame.shape(table(spark, d, "orders"))


@query("SELECT p_type, p_partkey FROM part WHERE p_size > 20 AND p_retailprice < 1500")
def tabular_select_filter(spark, d):
    p = table(spark, d, "part")
    return frame.select(frame.filter_mask(p, (F.col("p_size") > 20) & (F.col("p_retailprice") < 1500)), ["p_type", "p_partkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def tabular_head(spark, d):
    o = table(spark, d, "orders")
    return frame.head(o, 25, F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal, c_acctbal * 2 AS doubled FROM customer")
def tabular_with_column(spark, d):
    return frame.with_new_column(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "doubled", F.col("c_acctbal") * 2)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INT AS place FROM supplier")
def tabular_sort_double(spark, d):
    s = frame.numbered(table(spark, d, "supplier"), [*frame.double_order("s_acctbal", True), F.col("s_suppkey")])
    return s.select("s_suppkey", (F.col("rank") + 1).cast("int").alias("place"))


@query("SELECT a.key, a.name, a.v, b.name AS name_right, b.w FROM (SELECT n_regionkey AS key, n_name AS name, n_nationkey AS v FROM nation) a JOIN (SELECT r_regionkey AS key, r_name AS name, r_regionkey * 10 AS w FROM region) b USING (key)")
def tabular_join_suffix(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("v"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 10).alias("w"))
    return frame.join(a, b, "key")


def _join_sql(kind):
    return f"SELECT c_custkey, o_orderkey FROM customer {kind} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey"


def _joined(spark, d, how):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return frame.join(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", how)


@query(_join_sql("LEFT").replace("o_orderkey FROM", "coalesce(o_orderkey, -1) AS o_orderkey FROM", 1))
def tabular_left_join(spark, d):
    return _joined(spark, d, "left").fillna(-1, ["o_orderkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def tabular_semi_join(spark, d):
    return _joined(spark, d, "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def tabular_anti_join(spark, d):
    return _joined(spark, d, "left_anti")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS l_quantity_sum, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def tabular_cube(spark, d):
    return frame.grouping_sets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("l_quantity_sum", F.col("l_quantity_sum").cast("double"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS l_quantity_sum, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def tabular_rollup(spark, d):
    return frame.grouping_sets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "rollup").withColumn("l_quantity_sum", F.col("l_quantity_sum").cast("double"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def tabular_union(spark, d):
    return frame.set_operation(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "union")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def tabular_intersect(spark, d):
    return frame.set_operation(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "intersect")


@query(
    "WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY ALL) "
    "SELECT c.event_id, round(p.value, 4) AS value_asof FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t"
)
def tabular_asof_join(spark, d):
    e = events(spark, d)
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "t")
    return rounded(frame.asof_join(clicks, bought, ["user_id"], "t", ["value"]).select("event_id", "value_asof"))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def source_csv_round_trip(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = new_path(spark, "csv")
    files.write_csv(c, path)
    return files.read_csv(spark, path, c.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_jsonl_round_trip(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = new_path(spark, "jsonl")
    files.write_jsonl(n, path)
    return files.read_jsonl(spark, path, n.schema)


@query("SELECT o_custkey AS unit, row_number() OVER w AS cycle, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w AS rul FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def source_turbofan_lines(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").withColumn("cycle", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    lines = o.select(F.concat_ws(" ", F.col("o_custkey"), F.col("cycle"), *[F.lit(str(k * 0.5)) for k in range(24)]).alias("value"))
    return files.parse_turbofan(lines).select("unit", "cycle", "rul")


@query("SELECT o_custkey AS unit, row_number() OVER w AS cycle, least(count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w, 5) AS rul FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def source_clipped_targets(spark, d):
    return files.clip_targets(source_turbofan_lines(spark, d), "rul", 5)


@query(
    "SELECT p_partkey AS row, round(p_size + 0.5, 4) AS first, isnan(CASE WHEN p_partkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice END) AS missing, (p_size % 3 = 0)::INT AS label, '19/07/2008 ' || p_size AS at FROM part"
)
def source_process_rows(spark, d):
    p = table(spark, d, "part")
    price = F.when(F.col("p_partkey") % 7 == 0, "NaN").otherwise(F.col("p_retailprice").cast("string"))
    lines = p.select(F.col("p_partkey").alias("row"), F.concat_ws(" ", (F.col("p_size") + 0.5).cast("string"), price, F.lit("3")).alias("value"))
    labels = p.select(F.col("p_partkey").alias("row"), F.concat(F.when(F.col("p_size") % 3 == 0, "1").otherwise("-1"), F.lit(' "19/07/2008 '), F.col("p_size").cast("string"), F.lit('"')).alias("value"))
    found = files.parse_process_rows(lines, labels, width=3)
    return rounded(found.select("row", F.col("features")[0].alias("first"), F.isnan(F.col("features")[1]).alias("missing"), "label", "at"))


@query("SELECT l_orderkey AS \"group\", round(l_extendedprice, 4) AS target, round(l_discount, 4) AS a, round(l_quantity, 4) AS b, round(l_tax, 4) AS c FROM lineitem")
def source_drive_log(spark, d):
    li = table(spark, d, "lineitem").select("l_tax", F.col("l_extendedprice").alias("speed"), "l_quantity", F.col("l_orderkey").alias("segment_id"), "l_discount")
    path = new_path(spark, "drive")
    files.write_csv(li, path)
    found = files.parse_drive_log(files.read_csv(spark, path, li.schema), "speed")
    return rounded(found.select("group", "target", *[F.col("features")[k].alias(n) for k, n in enumerate("abc")]))
