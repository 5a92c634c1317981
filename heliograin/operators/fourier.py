"""Discrete Fourier transforms of long series over the cluster, by four steps.

A series of n = n1 n2 points is a table of n1 rows: its columns are transformed,
each result is turned by its twiddle factor, and the rows of the transposed table are
transformed. Both steps are groups of n1 or n2 points, some root of n, and
between them lies one shuffle; all n bins come out. A length without a divisor near its root
(a prime, say) is transformed as a convolution with a chirp, padded to a power of two.

Rows are (key, i, re, im), i from 0; absent rows are zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograin.sources.scratch import cut

#: Points that a task may transform at once.
MOST_POINTS = 1 << 14
_KEY = "_key"


def factor(n: int) -> int:
    """The largest divisor up to the root of n."""
    k = int(np.sqrt(n))
    while n % k:
        k -= 1
    return k


def _transformed(schema: T.StructType, n1: int, n2: int, first: bool):
    """One step: a group's points, by their place, to bins; the first step turns them by their twiddle factors."""

    def run(group: pa.Table) -> pa.Table:
        size = n1 if first else n2
        x = np.zeros(size, complex)
        # i = a n2 + b before, k1 n2 + b between, k1 + n1 k2 after
        i = group.column("i").to_numpy()
        other = int(i[0] % n2) if first else int(i[0] // n2)
        x[i // n2 if first else i % n2] = group.column("re").to_numpy() + 1j * group.column("im").to_numpy()
        x = np.fft.fft(x)
        k = np.arange(size)
        if first:
            turn = (k * other) % (n1 * n2)
            x *= np.exp(-2j * np.pi * turn / (n1 * n2))
        place = k * n2 + other if first else other + n1 * k
        key = group.column(_KEY)[0].as_py()
        return pa.table([pa.array([key] * size, group.schema.field(_KEY).type), pa.array(place, pa.int64()), pa.array(x.real), pa.array(x.imag)], names=[_KEY, "i", "re", "im"])

    return run


def _four_steps(points: DataFrame, n: int) -> DataFrame:
    """All bins of points (_key, i, re, im) whose series all have n places."""
    n1 = factor(n)
    n2 = n // n1
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    between = points.groupBy(_KEY, F.pmod("i", F.lit(n2))).applyInArrow(_transformed(points.schema, n1, n2, True), schema)
    return between.groupBy(_KEY, F.floor(F.col("i") / n2)).applyInArrow(_transformed(points.schema, n1, n2, False), schema)


def _chirped(points: DataFrame, n: int) -> DataFrame:
    """All n bins as a convolution with a chirp, over a power of two of places."""
    m = 1 << (2 * n - 2).bit_length()
    # i squared modulo 2 n in whole numbers keeps the angle exact
    angle = (F.col("i") * F.col("i") % (2 * n)) * float(np.pi / n)
    times = lambda re, im, sign: [(F.col("re") * re - sign * F.col("im") * im).alias("re"), (F.col("im") * re + sign * F.col("re") * im).alias("im")]
    turned = points.withColumn("a", angle).select(_KEY, "i", *times(F.cos("a"), F.sin("a"), -1))
    series = points.select(_KEY).distinct()
    chirp = series.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("a", angle)
    mirrored = F.explode(F.when(F.col("i") > 0, F.array("i", m - F.col("i"))).otherwise(F.array("i")))
    chirp = chirp.select(_KEY, mirrored.alias("i"), F.cos("a").alias("re"), F.sin("a").alias("im"))
    other = _four_steps(chirp, m).select(F.col(_KEY).alias("_of"), F.col("i").alias("_i"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = _four_steps(turned, m).join(other, F.col(_KEY).eqNullSafe(F.col("_of")) & (F.col("i") == F.col("_i"))).select(_KEY, "i", *times(F.col("_re"), F.col("_im"), 1))
    # the inverse transform by conjugates
    back = _four_steps(product.withColumn("im", -F.col("im")), m).filter(F.col("i") < n)
    back = back.select(_KEY, "i", (F.col("re") / m).alias("re"), (-F.col("im") / m).alias("im")).withColumn("a", angle)
    return back.select(_KEY, "i", *times(F.cos("a"), F.sin("a"), -1))


def transform(df: DataFrame, key: str, place: str, value: str, imaginary: str | None = None, most_points: int = MOST_POINTS) -> DataFrame:
    """Rows (key, bin, re, im): every bin of each series; a series' length is its largest place plus one.

    Null values and absent places are zeros, null places are left out; of rows with one place the sum counts. Null keys
    are one series. Series are transformed by length, so the number of different lengths should be small.
    """
    im = F.col(imaginary).cast("double") if imaginary else F.lit(0.0)
    points = df.filter(F.col(place).isNotNull()).groupBy(F.col(key).alias(_KEY), F.col(place).cast("long").alias("i"))
    points = cut(points.agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("re"), F.coalesce(F.sum(im), F.lit(0.0)).alias("im")))
    lengths = cut(points.groupBy(F.col(_KEY).alias("_of")).agg((F.max("i") + 1).alias("_n")))
    out = None
    for n in [r["_n"] for r in lengths.select("_n").distinct().orderBy("_n").collect()]:
        mine = points.join(lengths.filter(F.col("_n") == n), F.col(_KEY).eqNullSafe(F.col("_of")), "left_semi")
        made = _four_steps(mine, n) if n // factor(n) <= most_points else _chirped(mine, n)
        out = made if out is None else out.unionByName(made)
    out = points.limit(0) if out is None else out
    return out.select(F.col(_KEY).alias(key), F.col("i").alias("bin"), "re", "im")


def power(bins: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Rows (key, bin, power) of all bins: squared size over the length, of a table (key, n)."""
    of = lengths.select(F.col(key).alias("_of"), F.col("n").alias("_n"))
    return bins.join(of, F.col(key).eqNullSafe(F.col("_of"))).select(key, "bin", ((F.col("re") ** 2 + F.col("im") ** 2) / F.col("_n")).alias("power"))
