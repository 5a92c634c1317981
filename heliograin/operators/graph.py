"""Graph and lineage operators over edge tables (src, dst).

Iterations join the frontier with the edges and end when nothing is new; each
round is checkpointed to the shared folder, so lineage stays short and a lost
executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograin.sources.scratch import cut


def check_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges; a self-loop is an error when the result is read."""
    bad = F.when(F.col("src") == F.col("dst"), F.raise_error(F.concat(F.lit("self-loop at "), F.col("src").cast("string"))).cast("boolean")).otherwise(True)
    return edges.select("src", "dst").distinct().filter(bad)


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    return out.join(into, "node", "full").fillna(0)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def to_undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()


def roots_and_tips(edges: DataFrame) -> DataFrame:
    """Nodes without parents (root) or without children (tip)."""
    d = degrees(edges)
    return d.filter("parents = 0 or children = 0").select("node", F.when(F.col("parents") == 0, "root").otherwise("tip").alias("kind"))


class _Seen:
    """Rows found round by round, each round written once; every so often neighbouring rounds are written together, so that few files stay and a row is rewritten a logarithmic number of times."""

    def __init__(self, first: DataFrame):
        self.levels = [(1, first)]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [rows for _, rows in self.levels])

    def add(self, rows: DataFrame) -> None:
        self.levels.append((1, rows))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, cut(a.unionByName(b)) if n + m >= 8 else a.unionByName(b)))


def reachable(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows (start, node, hops): all nodes reachable from each start, itself at 0 hops (breadth first)."""
    frontier = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct())
    seen = _Seen(frontier)
    for hops in range(1, most_rounds + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.all(), ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)
    raise RuntimeError(f"nodes are more than {most_rounds} hops away")


def reached(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows (node): what any of the starts leads to, themselves included; grows with nodes and not with pairs."""
    frontier = cut(starts.select("node").distinct())
    seen = _Seen(frontier)
    for _ in range(most_rounds):
        step = edges.join(frontier, F.col("node") == F.col("src"), "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.all(), "node", "left_anti"))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)
    raise RuntimeError(f"nodes are more than {most_rounds} hops away")


def closure(edges: DataFrame) -> DataFrame:
    """Rows (src, dst, hops) of all ancestors and descendants."""
    return reachable(edges, nodes(edges)).filter("hops > 0").select(F.col("start").alias("src"), F.col("node").alias("dst"), "hops")


def shortest_path(edges: DataFrame, source, target) -> list:
    """One shortest path as nodes, the least predecessor at each step; empty if there is none. One row a hop reaches the driver."""
    starts = nodes(edges).filter(F.col("node") == F.lit(source))
    levels = reachable(edges, starts).select("node", "hops")
    at = levels.filter(F.col("node") == F.lit(target)).first()
    if at is None:
        return []
    path, hops = [target], at["hops"]
    while hops > 0:
        hops -= 1
        path.append(edges.filter(F.col("dst") == F.lit(path[-1])).join(levels.filter(F.col("hops") == hops), F.col("src") == F.col("node")).agg(F.min("src")).first()[0])
    return path[::-1]


def topological_levels(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rows (node, level): 0 without parents, else one more than the greatest parent's; a cycle is an error."""
    left = cut(edges.select("src", "dst").distinct())
    waiting = cut(nodes(edges))
    done = None
    for level in range(most_rounds):
        free = waiting.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        now = cut(free.withColumn("level", F.lit(level)))
        if now.isEmpty():
            if not waiting.isEmpty():
                raise ValueError("the graph has a cycle")
            break
        done = now if done is None else done.union(now)
        waiting = cut(waiting.join(now, "node", "left_anti"))
        left = cut(left.join(now, left.src == now.node, "left_anti"))
    return waiting.withColumn("level", F.lit(0)) if done is None else done


def unreachable(objects: DataFrame, edges: DataFrame, named: DataFrame) -> DataFrame:
    """Objects that no named root leads to (mark and sweep)."""
    return objects.join(reached(edges, named), "node", "left_anti")


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Rows (node, rank) after a fixed number of rounds; a node without children gives its rank to all."""
    every = cut(nodes(edges))
    n = every.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut(edges.join(out, "src"))
    rank = every.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        given = links.join(rank, links.src == rank.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        loose = rank.join(out, rank.node == out.src, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        rank = every.join(given, "node", "left").join(F.broadcast(loose), how="cross")  # one row
        rank = rank.select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if k % 5 == 4:
            rank = cut(rank)
    return rank


def neighbours(edges: DataFrame) -> DataFrame:
    """Rows (src, relation, targets): each node's sorted neighbours by relation of typed edges (src, relation, dst)."""
    return edges.groupBy("src", "relation").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def relations_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (src, dst, relation) of the typed edges between given pairs (src, dst)."""
    return pairs.join(edges, ["src", "dst"]).select("src", "dst", "relation").distinct()


def rerank_by_ancestry(hits: DataFrame, ancestors: DataFrame, boost: float) -> DataFrame:
    """Hits (query, id, score) with scores raised for ids that are ancestors of the query's node: (src, dst, hops)."""
    a = ancestors.select(F.col("dst").alias("query"), F.col("src").alias("id"), F.col("hops"))
    return hits.join(a, ["query", "id"], "left").withColumn("score", F.col("score") * (1 + F.coalesce(boost / F.col("hops"), F.lit(0.0)))).drop("hops")
