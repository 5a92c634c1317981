"""Flow queries over line items read as network flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import flows
from heliograin.plans.base import FLOWS, flows as view, query, rounded, table


@query(
    f"WITH {FLOWS} SELECT src_ip, dst_ip, count(*) AS n, round(avg(end_time - start_time), 4) AS duration, sum(bytes_out + bytes_in)::BIGINT AS total_bytes, sum(packets_out + packets_in)::BIGINT AS total_packets, "
    "round(avg(CASE WHEN end_time > start_time THEN 8.0 * (bytes_out + bytes_in) / (end_time - start_time) ELSE 0 END), 2) AS throughput, round(avg(bytes_in / bytes_out), 4) AS asymmetry FROM flows GROUP BY ALL"
)
def flows_derived(spark, d):
    f = flows.with_derived(view(spark, d)).groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration").alias("duration"), F.sum("total_bytes").alias("total_bytes"), F.sum("total_packets").alias("total_packets"), F.avg("throughput_bps").alias("throughput"), F.avg("asymmetry").alias("asymmetry")
    )
    return rounded(f.withColumn("throughput", F.round("throughput", 2)))


@query(
    f"WITH {FLOWS} SELECT floor(start_time / 2592000)::BIGINT AS span, count(*) AS flows, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, count(DISTINCT dst_port) AS dst_ports, count(DISTINCT src_port) AS src_ports, "
    "round(sum(syn_count) / sum(packets_out + packets_in), 6) AS syn_rate, round(sum(rst_count) / sum(packets_out + packets_in), 6) AS rst_rate, round(sum(error_count) / count(*), 6) AS error_rate FROM flows GROUP BY ALL"
)
def flows_window_summary(spark, d):
    f = view(spark, d).withColumn("span", F.floor(F.col("start_time") / 2592000))
    return rounded(flows.window_summary(f, ["span"]), 6)


@query(f"WITH {FLOWS}, g AS (SELECT src_ip, dst_ip, start_time - lag(start_time) OVER (PARTITION BY src_ip, dst_ip ORDER BY start_time) AS gap FROM flows) SELECT src_ip, dst_ip, count(gap) AS n, round(avg(gap), 2) AS mean_gap, max(gap) AS max_gap FROM g GROUP BY ALL")
def flows_inter_arrival(spark, d):
    g = flows.inter_arrival_times(view(spark, d), ["src_ip", "dst_ip"], "start_time")
    return rounded(g.groupBy("src_ip", "dst_ip").agg(F.count("gap").alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap")), 2)


@query(f"WITH {FLOWS}, c AS (SELECT src_ip, dst_port, count(*) AS n FROM flows GROUP BY ALL) SELECT src_ip, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY ALL")
def flows_entropy(spark, d):
    return rounded(flows.shannon_entropy(view(spark, d), ["src_ip"], "dst_port"), 6)


@query(f"WITH {FLOWS} SELECT CASE dst_port WHEN 22 THEN 'ssh' WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 25 THEN 'smtp' ELSE 'other' END AS protocol, count(*) AS n FROM flows GROUP BY ALL")
def flows_protocols(spark, d):
    return view(spark, d).groupBy(flows.protocol_of(F.col("dst_port")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


PORT_SCAN = (
    "port_scan AS (SELECT 'port_scan' AS detector, src_ip AS source, NULL::VARCHAR AS target, CASE WHEN hosts > ports THEN 'horizontal' WHEN hosts > 1 THEN 'block' ELSE 'vertical' END AS kind, "
    "least(0.4 + least(0.3, ports / 100.0) + least(0.3, n / 200.0), 1.0)::DOUBLE AS confidence, seen_at FROM (SELECT src_ip, max(start_time) AS seen_at, count(*) AS n, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS hosts FROM flows GROUP BY ALL) WHERE n >= 20 AND ports >= {ports})"
)
BRUTE = (
    "brute AS (SELECT 'brute_force' AS detector, src_ip AS source, dst_ip AS target, CASE WHEN sp > floor(2 * n / 3) THEN 'distributed_ports' WHEN err > rst THEN 'credential' ELSE 'connection' END AS kind, "
    "least(0.5 + 0.3 * ((rst + err) / (2.0 * n)) + least(0.2, n / 100.0), 1.0)::DOUBLE AS confidence, seen_at FROM (SELECT src_ip, dst_ip, dst_port, max(start_time) AS seen_at, count(*) AS n, sum(rst_count) AS rst, sum(error_count) AS err, count(DISTINCT src_port) AS sp FROM flows "
    "WHERE dst_port IN (21, 22, 23, 25, 80, 443) GROUP BY ALL) WHERE n >= 5 AND (rst + err) / (2.0 * n) >= 0.3)"
)
DNS = (
    "dns AS (SELECT 'dns_tunnel' AS detector, NULL::VARCHAR AS source, dst_ip AS target, 'tunnel' AS kind, least(score, 1.0)::DOUBLE AS confidence, seen_at FROM (SELECT dst_ip, max(start_time) AS seen_at, (CASE WHEN avg(bytes_out) > 512 THEN 0.25 ELSE 0 END + CASE WHEN sum(bytes_in) / sum(bytes_out) > 5 OR sum(bytes_in) / sum(bytes_out) < 0.2 THEN 0.2 ELSE 0 END "
    "+ CASE WHEN count(DISTINCT src_ip) <= 2 AND count(*) > 20 THEN 0.15 ELSE 0 END + CASE WHEN (sum(bytes_in) + sum(bytes_out)) / count(*) > 1000 THEN 0.2 ELSE 0 END + CASE WHEN count(DISTINCT src_port) > 5 THEN 0.2 ELSE 0 END)::DOUBLE AS score "
    "FROM flows WHERE dst_port = 53 GROUP BY ALL HAVING count(*) >= 10) WHERE score >= 0.5)"
)


@query(f"WITH {FLOWS}, {PORT_SCAN.format(ports=5)} SELECT * REPLACE (round(confidence, 4) AS confidence) FROM port_scan")
def flows_port_scan(spark, d):
    return rounded(flows.port_scans(view(spark, d), least_ports=5))


@query(f"WITH {FLOWS}, {BRUTE} SELECT * REPLACE (round(confidence, 4) AS confidence) FROM brute")
def flows_brute_force(spark, d):
    return rounded(flows.brute_force(view(spark, d)))


@query(f"WITH {FLOWS}, {DNS} SELECT * REPLACE (round(confidence, 4) AS confidence) FROM dns")
def flows_dns_tunnel(spark, d):
    return rounded(flows.dns_tunnels(view(spark, d)))


BEACON = (
    "gaps AS (SELECT src_ip, dst_ip, start_time, avg_payload_size AS p, start_time - lag(start_time) OVER (PARTITION BY src_ip, dst_ip ORDER BY start_time) AS gap FROM flows), talks AS (SELECT src_ip, dst_ip, max(start_time) AS seen_at, count(*) AS n, stddev_pop(gap) / avg(gap) AS gc, stddev_pop(p) / avg(p) AS pc FROM gaps GROUP BY ALL HAVING count(*) >= 10), "
    "scored AS (SELECT *, CASE WHEN gc < 2.0 THEN 0.45 ELSE 0 END + CASE WHEN pc < 2.0 THEN 0.3 ELSE 0 END + CASE WHEN n >= 20 THEN 0.25 ELSE 0 END AS score FROM talks), beacon AS (SELECT 'beacon' AS detector, src_ip AS source, dst_ip AS target, 'periodic' AS kind, least(score, 1.0)::DOUBLE AS confidence, seen_at FROM scored WHERE score >= 0.7)"
)
FLOOD = (
    "spans AS (SELECT floor(start_time / 86400)::BIGINT AS span, max(start_time) AS seen_at, sum(syn_count) / sum(packets_out + packets_in) AS syn, sum(rst_count) / sum(packets_out + packets_in) AS rst, sum(bytes_out + bytes_in) AS v FROM flows GROUP BY ALL), "
    "based AS (SELECT *, avg(v) OVER (ORDER BY span ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM spans), kinds AS (SELECT span, seen_at, CASE WHEN syn > 0.6 THEN 'syn_flood' WHEN rst > 0.5 THEN 'rst_flood' WHEN v > 1.5 * base THEN 'volumetric' END AS kind FROM based), "
    "flood AS (SELECT 'ddos' AS detector, NULL::VARCHAR AS source, span::VARCHAR AS target, kind, 0.8::DOUBLE AS confidence, seen_at FROM kinds WHERE kind IS NOT NULL)"
)


@query(f"WITH {FLOWS}, {BEACON} SELECT * REPLACE (round(confidence, 4) AS confidence) FROM beacon")
def flows_beacons(spark, d):
    return rounded(flows.beacons(view(spark, d), most_cv=2.0))


def _spans(spark, d):
    return view(spark, d).withColumn("span", F.floor(F.col("start_time") / 86400))


@query(f"WITH {FLOWS}, {FLOOD} SELECT * FROM flood")
def flows_floods(spark, d):
    return flows.floods(_spans(spark, d), "span", factor=1.5)


ALERTS = (
    f"WITH {FLOWS}, {PORT_SCAN.format(ports=15)}, {BRUTE}, {DNS}, {BEACON}, {FLOOD}, alerts AS (SELECT * FROM port_scan UNION ALL SELECT * FROM brute UNION ALL SELECT * FROM dns UNION ALL SELECT * FROM beacon UNION ALL SELECT * FROM flood)"
)


def _alerts(spark, d):
    return flows.alerts(_spans(spark, d), "span", most_cv=2.0, factor=1.5)


@query(f"{ALERTS} SELECT detector, count(*) AS n, round(avg(confidence), 4) AS confidence FROM alerts GROUP BY ALL")
def flows_alert_counts(spark, d):
    return rounded(_alerts(spark, d).groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence")))


@query(
    f"{ALERTS} SELECT 'CEF:0|heliograin|flows|1|' || detector || '|' || kind || '|' || floor(confidence * 10)::INT || '|src=' || coalesce(source, '') || ' dst=' || coalesce(target, '') AS line FROM alerts"
)
def flows_cef_lines(spark, d):
    return flows.event_lines(_alerts(spark, d), "cef")


@query(
    f"{ALERTS} SELECT '{{' || concat_ws(',', '\"detector\":\"' || detector || '\"', '\"source\":\"' || source || '\"', '\"target\":\"' || target || '\"', '\"kind\":\"' || kind || '\"', '\"confidence\":' || round(confidence::DECIMAL(18, 9), 4)::DOUBLE::VARCHAR, "
    "'\"severity\":\"' || CASE WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.8 THEN 'warning' ELSE 'info' END || '\"') || '}' AS line FROM alerts"
)
def flows_json_lines(spark, d):
    return flows.event_lines(_alerts(spark, d), "json")


@query(f"{ALERTS} SELECT 'LEEF:2.0|heliograin|flows|1|' || detector || '|' || chr(9) || 'sev=' || floor(confidence * 10)::INT || chr(9) || 'src=' || coalesce(source, '') || chr(9) || 'dst=' || coalesce(target, '') AS line FROM alerts")
def flows_leef_lines(spark, d):
    return flows.event_lines(_alerts(spark, d), "leef")


@query(
    f"{ALERTS}, s AS (SELECT source AS who, floor(seen_at / 2592000)::BIGINT AS span, count(*) AS n, list(DISTINCT detector) AS d FROM alerts WHERE source IS NOT NULL GROUP BY ALL), "
    "t AS (SELECT target AS who, floor(seen_at / 2592000)::BIGINT AS span, count(*) AS n, count(DISTINCT source) AS s FROM alerts WHERE target IS NOT NULL AND source IS NOT NULL GROUP BY ALL) "
    "SELECT who, span, CASE WHEN list_contains(d, 'port_scan') AND (list_contains(d, 'brute_force') OR list_contains(d, 'beacon')) THEN 'escalation' ELSE 'multi_attack' END AS kind, n FROM s WHERE (list_contains(d, 'port_scan') AND (list_contains(d, 'brute_force') OR list_contains(d, 'beacon'))) OR (n >= 2 AND len(d) >= 2) "
    "UNION ALL SELECT who, span, 'coordinated', n FROM t WHERE s >= 3"
)
def flows_correlations(spark, d):
    return flows.correlate(_alerts(spark, d), "seen_at", 2592000.0)


@query(
    "WITH tr AS (SELECT l_shipdate, l_linenumber AS k, l_suppkey AS a FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT k, count(*) AS n FROM tr GROUP BY ALL) SELECT l_linenumber AS k, count(*) AS n, round(max(-log2((coalesce(c.n, 0) + 1) / ((SELECT count(*) FROM tr) + 1)) + CASE WHEN l_suppkey IN (SELECT a FROM tr) THEN 0 ELSE 8 END), 4) AS score "
    "FROM lineitem LEFT JOIN c ON l_linenumber = c.k WHERE l_orderkey % 2 = 1 GROUP BY ALL"
)
def flows_rarity(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("a"), "l_orderkey")
    s = flows.rarity(li.filter("l_orderkey % 2 = 0").drop("l_orderkey"), li.filter("l_orderkey % 2 = 1").drop("l_orderkey"), "k", "a")
    return rounded(s.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")))


@query("WITH s AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part GROUP BY ALL) SELECT p_partkey, CASE WHEN sd < 1e-12 THEN true ELSE abs(p_retailprice - m) / sd <= 1.5 END AS keep FROM part JOIN s USING (p_brand)")
def flows_global_outliers(spark, d):
    return flows.global_outliers(table(spark, d, "part"), ["p_brand"], "p_retailprice", 1.5).select("p_partkey", "keep")


POINTS = "pts AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 50)::DOUBLE AS x, (s_suppkey * 13 % 50)::DOUBLE AS y, s_acctbal AS v FROM supplier)"
NEAR = f"WITH {POINTS}, n AS (SELECT a.id, b.id AS near, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, b.v FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS rank FROM n WHERE dist <= 8 QUALIFY rank <= 4)"


def _points(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 50).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 50).cast("double").alias("y"), F.col("s_acctbal").alias("v"))


@query(f"{NEAR} SELECT id, near, round(dist, 4) AS distance, rank::INT AS rank FROM k")
def flows_grid_neighbours(spark, d):
    p = _points(spark, d)
    return rounded(flows.grid_neighbours(p, p, "x", "y", 8.0, 4, "id"))


@query(f"{NEAR} SELECT id, round(coalesce(arg_min(v, rank) FILTER (dist < 1e-12), sum(v / dist ** 2) FILTER (dist >= 1e-12) / sum(1 / dist ** 2) FILTER (dist >= 1e-12)), 4) AS idw FROM k GROUP BY ALL")
def flows_idw(spark, d):
    p = _points(spark, d)
    return rounded(flows.idw(flows.grid_neighbours(p, p, "x", "y", 8.0, 4, "id"), p, "id", "v"))


@query(f"{NEAR}, m AS (SELECT id, avg(v) AS m, stddev_pop(v) AS s FROM k GROUP BY ALL) SELECT pts.id, CASE WHEN s IS NULL OR s < 1e-12 THEN true ELSE abs(pts.v - m) / s <= 1.5 END AS keep FROM pts LEFT JOIN m ON pts.id = m.id")
def flows_local_outliers(spark, d):
    p = _points(spark, d)
    return flows.local_outliers(flows.grid_neighbours(p, p, "x", "y", 8.0, 4, "id"), p, "id", "v", 1.5)


@query("SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 >= 1704500000 AND epoch_us(ts) / 1e6 < 1704600000")
def flows_packet_window(spark, d):
    from heliograin.plans.base import events

    return flows.packets_in(events(spark, d), "t", 1704500000.0, 1704600000.0).select("event_id")
