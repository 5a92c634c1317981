"""The relational core: projection, masks, ordering, grouped aggregates, joins with a right suffix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograin.sources.scratch import cut

_AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def with_new_column(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Append a column; a name that is there already is an error."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, column)


def select(df: DataFrame, names: list[str]) -> DataFrame:
    """Projection and reorder by name; unknown or repeated names are errors."""
    unknown = [n for n in names if n not in df.columns]
    if unknown or len(set(names)) < len(names):
        raise ValueError(f"unknown or repeated columns: {unknown or names}")
    return df.select(*names)


def filter_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask is true."""
    return df.filter(mask)


def head(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in a stated order."""
    return df.orderBy(*order).limit(k)


def double_order(name: str, descending: bool = False) -> list[Column]:
    """Sort keys for a double: NaN last in both directions, -0.0 before +0.0."""
    v = F.col(name)
    plus = F.when(v == 0, (v.cast("string") != "-0.0").cast("int")).otherwise(0)
    return [F.isnan(v).asc(), v.desc(), plus.desc()] if descending else [F.isnan(v).asc(), v.asc(), plus.asc()]


def sort_by_double(df: DataFrame, name: str, *ties, descending: bool = False) -> DataFrame:
    return df.orderBy(*double_order(name, descending), *ties)


def group_by_agg(df: DataFrame, keys: list[str] | str, value: str, functions: list[str] | str) -> DataFrame:
    """Grouped aggregates named <value>_<function>, as doubles."""
    keys, functions = ([x] if isinstance(x, str) else x for x in (keys, functions))
    unknown = [f for f in functions if f not in _AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregates: {unknown}")
    return df.groupBy(*keys).agg(*[_AGGREGATES[f](value).cast("double").alias(f"{value}_{f}") for f in functions])


def grouping_sets(df: DataFrame, keys: list[str], value: str, kind: str = "cube") -> DataFrame:
    """Sums and counts over the cube or rollup of the keys."""
    grouped = df.cube(*keys) if kind == "cube" else df.rollup(*keys)
    return grouped.agg(F.sum(value).alias(f"{value}_sum"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join on shared names; other names of the right side that the left has get the suffix _right."""
    on = [on] if isinstance(on, str) else on
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, how)


def set_operation(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    return {"union_all": a.unionByName, "union": lambda x: a.unionByName(x).distinct(), "intersect": a.intersect, "except": a.exceptAll}[kind](b)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """For each left row the right values at the latest time not after its own, by one union and one ordered window.

    Both sides keep their partitioning by ``by``; nothing is multiplied.
    """
    from pyspark.sql import Window as W

    tag = [F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values]
    a = left.select("*", *tag, F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (*by, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(0).alias("_side"))
    w = W.partitionBy(*by).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("_side") == 0, F.struct(f"_r_{v}")), ignorenulls=True).over(w).getField(f"_r_{v}").alias(f"{v}_asof") for v in values]
    return a.unionByName(b).select(*left.columns, "_side", *last).filter("_side = 1").drop("_side")


def total(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with gapless numbers from 0 in ``order``, which has to tell rows apart.

    Rows are range-partitioned and written once; numbers run inside partitions and start
    from the counts of those before (one row for each partition), so no task sorts all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_of", F.coalesce(F.sum("_n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    made = placed.withColumn(name, inside).join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return made.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_of", "_before")
