"""Text sources and sinks: strict CSV, JSON lines and three sensor data formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> None:
    """Header line, quotes only where needed, quotes doubled."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV under an explicit schema: header names are ignored; a wrong number of fields or a bad value is an error."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _numbers(line, n: int):
    parts = F.split(F.btrim(line), r"\s+")
    return F.when(F.size(parts) == n, F.transform(parts, lambda x: x.cast("double"))).otherwise(
        F.raise_error(F.format_string("a line has %d fields, not %d", F.size(parts), F.lit(n))).cast("array<double>")
    )


def parse_turbofan(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Run-to-failure rows: 26 blank-separated numbers (unit, cycle, 3 settings, 21 sensors) and rul = last cycle of the unit - cycle."""
    v = lines.filter(F.btrim(F.col(line_col)) != "").select(_numbers(F.col(line_col), 26).alias("v"))
    names = ["unit", "cycle", *[f"setting_{k}" for k in (1, 2, 3)], *[f"sensor_{k}" for k in range(1, 22)]]
    rows = v.select(*[(F.col("v")[k].cast("long") if k < 2 else F.col("v")[k]).alias(n) for k, n in enumerate(names)])
    last = rows.groupBy("unit").agg(F.max("cycle").alias("last_cycle"))
    return rows.join(last, "unit").withColumn("rul", F.col("last_cycle") - F.col("cycle")).drop("last_cycle")


def parse_process_rows(lines: DataFrame, labels: DataFrame, row_col: str = "row", line_col: str = "value", width: int = 590) -> DataFrame:
    """Wide sensor rows (NaN kept) with labels -1/1 read as 0/1, matched by row number: (row, features, label, at)."""
    left = lines.select(row_col, _numbers(F.col(line_col), width).alias("features"))
    parts = F.split(F.btrim(F.col(line_col)), r"\s+", 2)
    right = labels.select(row_col, ((parts[0].cast("int") + 1) / 2).cast("int").alias("label"), F.btrim(parts[1], F.lit('"')).alias("at"))
    return left.join(right, row_col)


def parse_drive_log(frame: DataFrame, target: str, group: str = "segment_id") -> DataFrame:
    """Headered channel rows as (group, target, features): every numeric column but those two, in order of name."""
    if target not in frame.columns or group not in frame.columns:
        raise ValueError(f"{target} and {group} are asked for")
    channels = sorted(c for c in frame.columns if c not in (target, group))
    return frame.select(F.col(group).alias("group"), F.col(target).cast("double").alias("target"), F.array(*[F.col(c).cast("double") for c in channels]).alias("features"))


def clip_targets(df: DataFrame, column: str, most: float) -> DataFrame:
    """``df`` with a column's values of at most ``most``; nulls stay."""
    return df.withColumn(column, F.when(F.col(column) > most, F.lit(most).cast(df.schema[column].dataType)).otherwise(F.col(column)))
