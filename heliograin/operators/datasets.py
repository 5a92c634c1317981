"""Dataset preparation and evaluation: splits, imputation, metrics, conformal intervals, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chance(*columns, seed: int = 0) -> Column:
    """A number in [0, 1) by a seeded hash of the columns, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def random_split(df: DataFrame, id_col: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``df`` with split: by a hash of the id, no sort and no shuffle."""
    upto, rule, u = 0.0, None, chance(id_col, seed=seed)
    total = sum(shares.values())
    for name, share in shares.items():
        upto += share / total
        rule = F.when(u < upto, name) if rule is None else rule.when(u < upto, name)
    return df.withColumn("split", rule.otherwise(list(shares)[-1]))


def grouped_split(df: DataFrame, group: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Like random_split, with whole groups."""
    return random_split(df, group, shares, seed)


def temporal_split(df: DataFrame, time: str, train_share: float) -> DataFrame:
    """``df`` with split: train up to the time quantile of the share, test after it."""
    edge = df.agg(F.percentile(time, F.lit(train_share)).alias("_edge"))
    return df.join(F.broadcast(edge), how="cross").withColumn("split", F.when(F.col(time) <= F.col("_edge"), "train").otherwise("test")).drop("_edge")  # one row


def leave_one_group_out(df: DataFrame, group: str, left_out) -> DataFrame:
    return df.withColumn("split", F.when(F.col(group).eqNullSafe(F.lit(left_out)), "test").otherwise("train"))


def validate(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and rows with a null, NaN or infinite value."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("bad_rows"))


def content_digest(df: DataFrame, columns: list[str | Column]) -> DataFrame:
    """One row with an order-free digest of the content: number, sum and xor of 60-bit heads of the rows' SHA-256 digests.

    A row is its columns as text, joined by unit separators, with a mark for null. Rows are digested where they lie.
    """
    cell = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00"))
    h = F.conv(F.substring(F.sha2(F.array_join(F.array(*map(cell, columns)), "\x1f"), 256), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("xor"))


def fit_imputer(train: DataFrame, columns: list[str], most_missing: float = 0.5) -> dict[str, float]:
    """Medians of the columns to keep: not all missing, not missing too often, not constant. One row reaches the driver."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    row = train.agg(
        F.count(F.lit(1)).alias("_n"), *[x for c in columns for x in (F.count(real(c)).alias(f"n_{c}"), F.percentile(real(c), F.lit(0.5)).alias(f"m_{c}"), F.min(real(c)).alias(f"lo_{c}"), F.max(real(c)).alias(f"hi_{c}"))]
    ).first()
    return {c: row[f"m_{c}"] for c in columns if row[f"n_{c}"] and row[f"n_{c}"] >= (1 - most_missing) * row["_n"] and row[f"lo_{c}"] < row[f"hi_{c}"]}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(m)).otherwise(F.col(c)) for c, m in medians.items()})


def regression_errors(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_error"), F.max(F.abs(e)).alias("worst_error"))


def detection_report(df: DataFrame, keys: list[str], label: str, score: str, threshold: float) -> DataFrame:
    """Confusion counts of score > threshold and their ratios, null where a denominator is 0."""
    yes, real = F.col(score) > threshold, F.col(label) == 1
    c = df.groupBy(*keys).agg(*[F.count(F.when(x, 1)).alias(n) for n, x in (("tp", yes & real), ("fp", yes & ~real), ("fn", ~yes & real), ("tn", ~yes & ~real))])
    ratio = lambda a, *b: F.when(sum((F.col(x) for x in b), F.lit(0)) > 0, F.col(a) / sum((F.col(x) for x in b), F.lit(0)))
    precision, recall, tnr = ratio("tp", "tp", "fp"), ratio("tp", "tp", "fn"), ratio("tn", "tn", "fp")
    return c.select(
        *keys, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"),
        ratio("fp", "fp", "tn").alias("false_alarm_rate"), ratio("fn", "tp", "fn").alias("missed_rate"), ((recall + tnr) / 2).alias("balanced_accuracy"),
    )


def auroc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; scores are counted first, so ties cost one row."""
    s = df.groupBy(*keys, score).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = s.withColumn("w", F.col("p") * (below + F.col("n") / 2))
    return wins.groupBy(*keys).agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum("w") / (F.sum("p").cast("double") * F.sum("n"))).alias("auroc"))


def rand_indexes(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand and adjusted Rand index of two clusterings, from pair counts of the contingency table."""
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = lambda keys: cells.groupBy(*keys).agg(F.sum("n").alias("n")).agg(two("n").alias("s")) if keys else cells.agg(F.sum("n").alias("n")).agg(two("n").alias("s"))
    row = cells.agg(two("n").alias("ab")).join(s([a]).toDF("a"), how="cross").join(s([b]).toDF("b"), how="cross").join(s([]).toDF("all"), how="cross")  # one row each
    expected = F.col("a") * F.col("b") / F.col("all")
    return row.select(
        ((F.col("all") + 2 * F.col("ab") - F.col("a") - F.col("b")) / F.col("all")).alias("rand"),
        F.when((F.col("a") + F.col("b")) / 2 != expected, (F.col("ab") - expected) / ((F.col("a") + F.col("b")) / 2 - expected)).otherwise(1.0).alias("adjusted_rand"),
    )


def conformal_width(calibration: DataFrame, keys: list[str], residual: str, level: float) -> DataFrame:
    """The ceil((n + 1) * level)-th least absolute residual of each key; null where the rank exceeds n."""
    by = W.partitionBy(*keys)
    r = calibration.select(*keys, F.abs(F.col(residual)).alias("_r"))
    r = r.withColumns({"_i": F.row_number().over(by.orderBy("_r")), "_n": F.count(F.lit(1)).over(by)})
    rank = F.ceil((F.col("_n") + 1) * level)
    return r.groupBy(*keys).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_i") == rank, F.col("_r"))).alias("half_width"))


def mondrian_width(calibration: DataFrame, group: str, residual: str, level: float) -> DataFrame:
    """Half-widths by group; a group too small for its rank takes the pooled one and is flagged."""
    own = conformal_width(calibration, [group], residual, level)
    pooled = conformal_width(calibration.withColumn("_all", F.lit(1)), ["_all"], residual, level).select(F.col("half_width").alias("pooled"))
    return own.join(F.broadcast(pooled), how="cross").select(group, "n", F.coalesce("half_width", "pooled").alias("half_width"), F.col("half_width").isNotNull().alias("conditionally_valid"))  # one row


def coverage(df: DataFrame, keys: list[str], actual: str, predicted: str, half_width: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.abs(F.col(actual) - F.col(predicted)) <= F.col(half_width)).cast("double")).alias("coverage"))


def stability_index(reference: DataFrame, current: DataFrame, value: str, bins: int) -> DataFrame:
    """Population stability index over equal-width bins of the reference range; 0.5 is added to each count.

    Values below the range fall into the first bin, values above it into the last.
    """
    ends = reference.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        at = F.least(F.greatest(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1))
        return df.join(F.broadcast(ends), how="cross").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias(name))  # one row

    grid = reference.sparkSession.range(bins).withColumnRenamed("id", "bin")
    both = grid.join(counted(reference, "r"), "bin", "left").join(counted(current, "c"), "bin", "left").fillna(0)
    total = both.agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    p, q = (F.col("r") + 0.5) / F.col("_r"), (F.col("c") + 0.5) / F.col("_c")
    return both.join(F.broadcast(total), how="cross").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))  # one row


def paired_differences(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.when(F.stddev_samp(d) > 0, F.avg(d) / F.stddev_samp(d)).alias("effect_size"))


def paired_bootstrap(df: DataFrame, a: str, b: str, id_col: str, rounds: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """Bootstrap interval of the mean difference: Poisson(1) weights by a hash of id and round, one aggregate over rows x rounds."""
    d = df.select(F.col(id_col).alias("_id"), (F.col(a) - F.col(b)).alias("_d"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_round"))
    u, upto, term, w = chance("_id", "_round", seed=seed), 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        upto += term
        w = w + (u >= upto).cast("int")
        term /= k + 1
    means = d.withColumn("_w", w).groupBy("_round").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("_m"))
    return means.agg(F.percentile("_m", F.lit(low)).alias("low"), F.percentile("_m", F.lit(high)).alias("high"))


def clip(value: Column, most: float) -> Column:
    return F.least(value, F.lit(most))


def batches(df: DataFrame, order: list, size: int, drop_last: bool = False) -> DataFrame:
    """``df`` with batch: rows numbered in order, by range partitions rather than one sorted task."""
    from heliograin.sources.scratch import cut

    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    total = sizes.agg(F.sum("_n").alias("_all"))
    numbered = parts.join(F.broadcast(before), "_p").join(F.broadcast(total), how="cross")  # rows of partitions; one row
    found = numbered.withColumn("batch", F.floor((F.col("_before") + F.col("_m") - F.col("_first")) / size))
    if drop_last:
        found = found.filter((F.col("batch") + 1) * size <= F.col("_all"))
    return found.drop("_p", "_m", "_n", "_first", "_before", "_all")


def pad(sample: Column, length: int, fill: float = 0.0) -> Column:
    return F.slice(F.concat(sample, F.array_repeat(F.lit(fill), length)), 1, length)


def contaminate(df: DataFrame, id_col: str, value: str, rate: float, size: float, seed: int = 0) -> DataFrame:
    """``df`` with seeded spikes of ``size`` added to a share of the values, and the manifest column spiked."""
    hit = chance(id_col, seed=seed) < rate
    return df.withColumn("spiked", hit).withColumn(value, F.when(hit, F.col(value) + size).otherwise(F.col(value)))


def isotonic_blocks(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Rows (bin, fit): the isotonic fit of equal-width bin means, max over starts of min over ends of pooled means.

    The data are reduced to ``bins`` sums first; the pairs of bins are bounded by that parameter.
    """
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    b = df.join(F.broadcast(ends), how="cross").groupBy(at.alias("bin")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))  # one row
    w = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    c = b.select("bin", F.sum("s").over(w).alias("cs"), F.sum("n").over(w).alias("cn"), F.coalesce(F.sum("s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("bs"), F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bn"))
    start = c.select(F.col("bin").alias("i"), "bs", "bn")
    end = c.select(F.col("bin").alias("j"), "cs", "cn")
    pooled = start.join(end, F.col("i") <= F.col("j")).withColumn("m", (F.col("cs") - F.col("bs")) / (F.col("cn") - F.col("bn")))
    low = pooled.withColumn("low", F.min("m").over(W.partitionBy("i").orderBy("j").rowsBetween(0, W.unboundedFollowing)))
    return low.groupBy(F.col("j").alias("bin")).agg(F.max("low").alias("fit"))
