"""Sparse weighted least squares and bad-data tests, on matrices as rows (row, col, v).

The normal equations (H' W H) x = H' W z are solved by conjugate gradients, scaled by
their diagonal. Rows of at most ``SHORT`` entries are summed once into the products of their columns, which
rounds multiply by; longer rows are multiplied by H and by its transpose, each a join on the
inner index and a sum. Vectors are written each round. Several right-hand sides go together as one column ``rhs``.
Only a few numbers for each right-hand side reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograin.sources.scratch import beside, cut

#: Entries up to which a row's products by pairs are formed; a round multiplies by longer rows as they are.
SHORT = 16
#: Right-hand sides that go together when residuals are normalised.
BLOCK = 64


def matrix(entries: DataFrame) -> DataFrame:
    """Rows (row, col, v): entries of one place summed, nulls and zeros left out."""
    return entries.dropna(subset=["row", "col", "v"]).groupBy("row", "col").agg(F.sum(F.col("v").cast("double")).alias("v")).filter("v <> 0")


def normal_parts(h: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (to, col, g): H' W H of the short rows, at most one row for each pair of columns; and the entries of the longer rows, if there are any."""
    lengths = h.groupBy("row").agg(F.count(F.lit(1)).alias("_k"))
    short = h.join(lengths.filter(F.col("_k") <= SHORT).select("row"), "row", "left_semi")
    pairs = short.join(weights, "row").join(short.select("row", F.col("col").alias("to"), F.col("v").alias("_v")), "row")
    g = cut(pairs.groupBy("to", "col").agg(F.sum(F.col("v") * F.col("_v") * F.col("weight")).alias("g")))
    long = cut(h.join(lengths.filter(F.col("_k") > SHORT).select("row"), "row", "left_semi"))
    return g, None if long.isEmpty() else long


def _normal(parts: tuple[DataFrame, DataFrame | None], weights: DataFrame, x: DataFrame) -> DataFrame:
    """Rows (rhs, col, v): H' W H x."""
    g, h = parts
    short = g.join(x.withColumnRenamed("v", "_x"), "col").groupBy("rhs", "to").agg(F.sum(F.col("g") * F.col("_x")).alias("v")).select("rhs", F.col("to").alias("col"), "v")
    if h is None:
        return short
    ahead = h.join(x.withColumnRenamed("v", "_x"), "col").groupBy("rhs", "row").agg(F.sum(F.col("v") * F.col("_x")).alias("_y"))
    ahead = ahead.join(weights, "row").withColumn("_y", F.col("_y") * F.col("weight"))
    each = ahead.join(h, "row").select("rhs", "col", (F.col("v") * F.col("_y")).alias("v"))
    return short.unionByName(each).groupBy("rhs", "col").agg(F.sum("v").alias("v"))


def conjugate_gradients(h: DataFrame, weights: DataFrame, b: DataFrame, tolerance: float = 1e-12, most_rounds: int = 1000, parts: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """Rows (rhs, col, v): x of (H' W H) x = b, b as rows (rhs, col, v); H as rows (row, col, v), weights as (row, weight), ``parts`` as ``normal_parts`` makes them.

    Stops when every residual is below ``tolerance`` times its right-hand side. A singular system is an error.
    """
    parts = parts or normal_parts(h, weights)
    scale = parts[0].filter(F.col("to") == F.col("col")).select("col", F.col("g").alias("_s"))
    if parts[1] is not None:
        scale = scale.unionByName(parts[1].join(weights, "row").select("col", (F.col("v") ** 2 * F.col("weight")).alias("_s")))
    scale = scale.groupBy("col").agg((1 / F.sum("_s")).alias("_d"))
    rhs = sorted(r["rhs"] for r in b.select("rhs").distinct().collect())
    if not rhs:
        return b.select("rhs", "col", "v")
    each = lambda found: F.element_at(F.create_map(*[F.lit(x) for k in rhs for x in (k, float(found[k]))]), F.col("rhs"))
    sums = lambda rows, **of: {r["rhs"]: r for r in rows.groupBy("rhs").agg(*[F.sum(c).alias(n) for n, c in of.items()]).collect()}
    r, d, p = F.col("r"), F.col("_d"), F.col("p")
    state = scale.withColumn("rhs", F.explode(F.array(*map(F.lit, rhs)))).join(b, ["rhs", "col"], "left")
    state = cut(state.select("rhs", "col", "_d", F.lit(0.0).alias("x"), F.coalesce("v", F.lit(0.0)).alias("r")).withColumn("p", r * d))
    now = sums(state, rz=r * r * d, rr=r * r)
    goal = {k: now[k]["rr"] * tolerance**2 for k in rhs}
    for _ in range(most_rounds):
        if all(now[k]["rr"] <= goal[k] for k in rhs):
            return state.select("rhs", "col", F.col("x").alias("v"))
        ap = _normal(parts, weights, state.select("rhs", "col", p.alias("v"))).withColumnRenamed("v", "_ap")
        joined = cut(state.join(ap, ["rhs", "col"], "left").fillna(0.0, ["_ap"]))
        curve = sums(joined, pap=p * F.col("_ap"))
        alpha = each({k: now[k]["rz"] / curve[k]["pap"] if curve[k]["pap"] > 0 else 0.0 for k in rhs})
        moved = joined.withColumns({"x": F.col("x") + alpha * p, "r": r - alpha * F.col("_ap")})
        after = sums(moved, rz=r * r * d, rr=r * r)
        beta = each({k: after[k]["rz"] / now[k]["rz"] if now[k]["rz"] else 0.0 for k in rhs})
        state, now = moved.withColumn("p", r * d + beta * p).select("rhs", "col", "_d", "x", "r", "p"), after
    raise RuntimeError(f"not solved in {most_rounds} rounds: the measurements may not determine all unknowns")


def least_squares(h: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unknowns (col, x) and residuals (row, z, fitted, residual, weight) of measurements (row, z, sigma); weights are 1 / sigma**2.

    Measurements without a value or a positive sigma are left out; a measurement without entries in H keeps its value as residual.
    """
    good = cut(measured.filter("z is not null and sigma > 0").select("row", F.col("z").cast("double").alias("z"), (1 / F.col("sigma") ** 2).alias("weight")))
    h = cut(matrix(h).join(good.select("row"), "row", "left_semi"))
    weights = good.select("row", "weight")
    b = h.join(good, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("weight") * F.col("z")).alias("v")).select(F.lit(0).cast("long").alias("rhs"), "col", "v")
    x = conjugate_gradients(h, weights, b).select("col", F.col("v").alias("x"))
    fitted = h.join(x, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("fitted"))
    left = good.join(fitted, "row", "left").withColumn("fitted", F.coalesce("fitted", F.lit(0.0)))
    return x, left.select("row", "z", "fitted", (F.col("z") - F.col("fitted")).alias("residual"), "weight")


def chi_square(residuals: DataFrame, unknowns: DataFrame) -> DataFrame:
    """One row (objective, dof): the weighted sum of squared residuals, and its degrees of freedom."""
    n = unknowns.agg(F.count(F.lit(1)).alias("_n"))
    total = residuals.agg(F.sum(F.col("residual") ** 2 * F.col("weight")).alias("objective"), F.count(F.lit(1)).alias("_m"))
    return total.crossJoin(n).select("objective", (F.col("_m") - F.col("_n")).alias("dof"))


def _blocks(rows: DataFrame, of: str) -> list:
    """Rows dealt by ``of`` into blocks of about BLOCK right-hand sides, one at a time."""
    n = -(-rows.select(of).distinct().count() // BLOCK)
    for k in range(n):
        yield rows.filter(F.pmod(F.xxhash64(of), F.lit(n)) == k)


def _gains(kinds: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (line, _gain): h G**-1 h' of the asked ones among lines (kind, line, weight), weights those of all measurements of a line."""
    each = lambda of: of.select(F.col("kind").alias("row"), (F.size("line") <= SHORT).alias("_short"), F.inline("line"))
    h, weights, own = each(kinds).drop("_short"), kinds.select(F.col("kind").alias("row"), "weight"), each(asked)
    parts, short = normal_parts(h, weights), own.filter("_short")
    size = short.agg(F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols")).first()
    gains = []
    if size["rows"] > size["cols"]:  # columns of G**-1, of which each line adds up its pairs of entries
        for block in _blocks(short.select("col").distinct(), "col"):
            y = conjugate_gradients(h, weights, block.select(F.col("col").alias("rhs"), "col", F.lit(1.0).alias("v")), parts=parts).withColumnRenamed("v", "_y")
            pairs = short.select("row", F.col("col").alias("rhs"), "v").join(short.select("row", "col", F.col("v").alias("_v")), "row").join(y, ["rhs", "col"])
            gains.append(cut(pairs.groupBy("row").agg(F.sum(F.col("v") * F.col("_v") * F.col("_y")).alias("_gain"))))
        own = own.filter("not _short")
    for block in _blocks(own, "row"):  # each line a right-hand side
        block = block.select(F.col("row").alias("rhs"), "col", "v")
        y = conjugate_gradients(h, weights, block, parts=parts).withColumnRenamed("v", "_y")
        gains.append(cut(y.join(block, ["rhs", "col"]).groupBy(F.col("rhs").alias("row")).agg(F.sum(F.col("v") * F.col("_y")).alias("_gain"))))
    if not gains:
        return asked.select("line", F.lit(0.0).alias("_gain")).limit(0)
    total = reduce(DataFrame.unionByName, gains).groupBy("row").agg(F.sum("_gain").alias("_gain"))
    return asked.join(total, F.col("kind") == F.col("row")).select("line", "_gain")


def normalized_residuals(h: DataFrame, residuals: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows (row, residual, normalized) of all measurements with entries in H, or of those named by ``rows`` (row): the residual over its own standard deviation.

    Its variance is sigma**2 - h G**-1 h', null where that is zero, as no other measurement tells anything about
    it. Measurements of equal entries share the second part, which is found once for each such line: by the columns of G**-1
    or, for long lines and where lines are fewer than columns, by a right-hand side for each. A line is held by one task.
    """
    held = matrix(h.repartition("row")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("line"))
    lines = residuals.select("row", "residual", "weight").join(held, "row")
    kinds = cut(lines.groupBy("line").agg(F.sum("weight").alias("weight")).withColumn("kind", F.monotonically_increasing_id()))
    asked = kinds
    if rows is not None:
        lines = lines.join(rows.select("row").distinct(), "row", "left_semi")
        asked = cut(kinds.join(lines.select("line").distinct(), "line", "left_semi"))
    found = lines.join(beside(_gains(kinds, asked)), "line")
    variance = 1 / F.col("weight") - F.col("_gain")
    return found.select("row", "residual", F.when(variance * F.col("weight") > 1e-9, F.abs("residual") / F.sqrt(variance)).alias("normalized"))
