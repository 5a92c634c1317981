"""Graph queries over a forest of customers (parent = key / 3) and over the region-nation-supplier lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograin.operators import graph
from heliograin.plans.base import query, rounded, table

TREE = "edges AS (SELECT c_custkey // 3 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 0)"
UP = f"WITH RECURSIVE {TREE}, up(src, dst, hops) AS (SELECT src, dst, 1 FROM edges UNION ALL SELECT e.src, up.dst, hops + 1 FROM up JOIN edges e ON e.dst = up.src)"


def _tree(spark, d):
    return table(spark, d, "customer").filter("c_custkey > 0").select(F.floor(F.col("c_custkey") / 3).alias("src"), F.col("c_custkey").alias("dst"))


LINEAGE = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def _lineage(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return n.union(table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"))).distinct()


@query(f"WITH {LINEAGE} SELECT node, count(*) FILTER (side = 's') AS children, count(*) FILTER (side = 'd') AS parents FROM (SELECT src AS node, 's' AS side FROM edges UNION ALL SELECT dst, 'd' FROM edges) GROUP BY ALL")
def graph_degrees(spark, d):
    return graph.degrees(_lineage(spark, d))


@query(f"WITH {LINEAGE} SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def graph_undirected(spark, d):
    return graph.to_undirected(_lineage(spark, d))


@query(f"WITH {LINEAGE}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, CASE WHEN node NOT IN (SELECT dst FROM edges) THEN 'root' ELSE 'tip' END AS kind FROM n WHERE node NOT IN (SELECT dst FROM edges) OR node NOT IN (SELECT src FROM edges)")
def graph_roots_and_tips(spark, d):
    return graph.roots_and_tips(_lineage(spark, d))


@query(f"{UP} SELECT src, dst, hops::INT AS hops FROM up")
def graph_closure(spark, d):
    return graph.closure(_tree(spark, d))


@query(f"{UP} SELECT src AS start, dst AS node, hops::INT AS hops FROM up WHERE src IN (1, 2) UNION ALL VALUES (1, 1, 0), (2, 2, 0)")
def graph_reachable(spark, d):
    starts = spark.createDataFrame([(1,), (2,)], "node long")
    return graph.reachable(_tree(spark, d), starts)


@query(f"{UP} SELECT dst AS node, max(hops)::INT AS level FROM up GROUP BY ALL UNION ALL SELECT 0, 0")
def graph_topological_levels(spark, d):
    return graph.topological_levels(_tree(spark, d))


@query(f"{UP} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM up WHERE src = 5) AND c_custkey <> 5")
def graph_unreachable(spark, d):
    return graph.unreachable(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), _tree(spark, d), spark.createDataFrame([(5,)], "node long"))


@query(f"WITH RECURSIVE {TREE}, walk(node, path) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL SELECT e.dst, list_append(path, e.dst) FROM walk JOIN edges e ON e.src = walk.node), found AS (SELECT path FROM walk WHERE node = 35 ORDER BY len(path) LIMIT 1) SELECT unnest(path) AS node, unnest(range(len(path)))::INT AS place FROM found")
def graph_shortest_path(spark, d):
    path = graph.shortest_path(_tree(spark, d), 0, 35)
    return spark.createDataFrame([(int(n), k) for k, n in enumerate(path)], "node long, place int")


def ranked(edges: str, rounds: int, damping: float = 0.85) -> str:
    """SQL parts (node, rank) k0 .. k<rounds> of page rank over the rows (src, dst) of ``edges``, and the node and child counts they read."""
    parts = [
        f"pn AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}), pc AS (SELECT count(*) AS n FROM pn), po AS (SELECT src, count(*) AS out FROM {edges} GROUP BY ALL)",
        "k0 AS (SELECT node, 1::DOUBLE / n AS rank FROM pn, pc)",
    ]
    for k in range(rounds):
        parts.append(
            f"g{k} AS (SELECT dst AS node, sum(rank / out) AS got FROM {edges} JOIN po USING (src) JOIN k{k} ON node = src GROUP BY ALL), l{k} AS (SELECT coalesce(sum(rank), 0) AS loose FROM k{k} WHERE node NOT IN (SELECT src FROM po)), "
            f"k{k + 1} AS MATERIALIZED (SELECT node, {1 - damping!r}::DOUBLE / n + {damping} * (coalesce(got, 0) + loose / n) AS rank FROM pn LEFT JOIN g{k} USING (node), l{k}, pc)"
        )
    return ", ".join(parts)


@query(f"WITH {LINEAGE}, {ranked('edges', 20)} SELECT node, round(rank, 8) AS rank FROM k20")
def graph_page_rank(spark, d):
    return rounded(graph.page_rank(_lineage(spark, d)), 8)


@query(f"WITH {LINEAGE} SELECT src, dst FROM edges")
def graph_checked_edges(spark, d):
    return graph.check_edges(_lineage(spark, d))


TYPED = "typed AS (SELECT 'n' || n_nationkey AS src, 'in' AS relation, 'r' || n_regionkey AS dst FROM nation UNION SELECT 's' || s_suppkey, 'of', 'n' || s_nationkey FROM supplier UNION SELECT 'n' || s_nationkey, 'has', 's' || s_suppkey FROM supplier)"


def _typed(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    rows = [
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("in").alias("relation"), F.concat(F.lit("r"), "n_regionkey").alias("dst")),
        s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("of").alias("relation"), F.concat(F.lit("n"), "s_nationkey").alias("dst")),
        s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.lit("has").alias("relation"), F.concat(F.lit("s"), "s_suppkey").alias("dst")),
    ]
    return rows[0].union(rows[1]).union(rows[2]).distinct()


@query(f"WITH {TYPED} SELECT src, relation, string_agg(dst, ',' ORDER BY dst) AS targets FROM typed GROUP BY ALL")
def graph_neighbours(spark, d):
    return graph.neighbours(_typed(spark, d)).withColumn("targets", F.array_join("targets", ","))


@query(f"WITH {TYPED} SELECT src, dst, relation FROM typed WHERE src LIKE 'n1%' AND dst LIKE 's%'")
def graph_relations_between(spark, d):
    t = _typed(spark, d)
    return graph.relations_between(t, t.filter("src like 'n1%' and dst like 's%'").select("src", "dst").distinct())


@query(f"{UP}, h AS (SELECT c_custkey AS query, c_custkey // 3 AS id, 1.0::DOUBLE AS score FROM customer WHERE c_custkey > 0 AND c_custkey % 20 = 0 UNION ALL SELECT c_custkey, c_custkey // 9, 1.0 FROM customer WHERE c_custkey > 8 AND c_custkey % 20 = 0) SELECT query, id, round(score * (1 + coalesce(0.5 / hops, 0)), 6) AS score FROM h LEFT JOIN up ON up.dst = query AND up.src = id")
def graph_rerank(spark, d):
    c = table(spark, d, "customer").filter("c_custkey > 0 and c_custkey % 20 = 0")
    one = c.select(F.col("c_custkey").alias("query"), F.floor(F.col("c_custkey") / 3).alias("id"), F.lit(1.0).alias("score"))
    two = c.filter("c_custkey > 8").select(F.col("c_custkey").alias("query"), F.floor(F.col("c_custkey") / 9).alias("id"), F.lit(1.0).alias("score"))
    return rounded(graph.rerank_by_ancestry(one.union(two), graph.closure(_tree(spark, d)), 0.5), 6)
