"""Exact decimal business rules: accrual, day counts, brackets, conversion, annuities, schedules.

Amounts are decimals; rounding is half away from zero (Spark's ``round``), and
happens where a rule says so and nowhere else.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, getcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,18)"
MONEY = "decimal(18,2)"
#: Values of a nine-digit money field.
MOST = Decimal("999999999.99")


def monthly_interest(principal: Column, annual_rate: Column) -> Column:
    """A twelfth of the year's interest, unrounded: one division of exact products."""
    return principal.cast("decimal(14,2)") * annual_rate.cast("decimal(9,7)") / F.lit(12).cast("decimal(2,0)")


def accrue(principal: Column, annual_rate: Column) -> Column:
    """A struct (rounded, truncated, balance) of one month's interest; a balance outside the field is an error."""
    raw = monthly_interest(principal, annual_rate)
    rounded = F.round(raw, 2).cast(MONEY)
    cents = F.when(raw >= 0, F.floor(raw * 100)).otherwise(F.ceil(raw * 100))
    balance = (principal.cast(MONEY) + rounded).cast(MONEY)
    checked = F.when(F.abs(balance) > F.lit(MOST), F.raise_error("balance outside the field").cast(MONEY)).otherwise(balance)
    return F.struct(rounded.alias("rounded"), (cents / F.lit(Decimal(100))).cast(MONEY).alias("truncated"), checked.alias("balance"))


def days_30_360(start: Column, end: Column) -> Column:
    """US 30/360 days, with the February rules first."""
    last_feb = lambda d: (F.month(d) == 2) & (F.last_day(d) == d)
    d1, d2 = F.dayofmonth(start), F.dayofmonth(end)
    d2 = F.when(last_feb(start) & last_feb(end), 30).otherwise(d2)
    d1 = F.when(last_feb(start), 30).otherwise(d1)
    d2 = F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
    d1 = F.when(d1 == 31, 30).otherwise(d1)
    return 360 * (F.year(end) - F.year(start)) + 30 * (F.month(end) - F.month(start)) + (d2 - d1)


def interest_30_360(principal: Column, rate: Column, start: Column, end: Column) -> Column:
    days = days_30_360(start, end).cast("decimal(8,0)")
    return F.round(principal.cast("decimal(14,2)") * rate.cast("decimal(9,7)") * days / F.lit(360).cast("decimal(3,0)"), 2).cast(MONEY)


def bracket_tax(base: Column, brackets: list[tuple[Decimal, Decimal]]) -> Column:
    """Marginal tax of (threshold, rate) brackets from 0 up, rounded once at the end."""
    total = F.lit(Decimal(0)).cast("decimal(30,10)")
    for (low, rate), high in zip(brackets, [b[0] for b in brackets[1:]] + [None]):
        top = base if high is None else F.least(base, F.lit(high).cast(MONEY))
        part = F.greatest(top.cast(MONEY) - F.lit(low).cast(MONEY), F.lit(Decimal(0)).cast(MONEY))
        total = (total + part * F.lit(rate).cast("decimal(9,7)")).cast("decimal(30,10)")
    return F.round(total, 2).cast(MONEY)


def flat_top_tax(base: Column, brackets: list[tuple[Decimal, Decimal]]) -> Column:
    """The whole base at the rate of the bracket that it reaches."""
    rate = F.lit(brackets[0][1])
    for low, r in brackets[1:]:
        rate = F.when(base >= F.lit(low), F.lit(r)).otherwise(rate)
    return F.round(base.cast(MONEY) * rate.cast("decimal(9,7)"), 2).cast(MONEY)


def convert(amount: Column, rate_from: Column, rate_to: Column, euro_scale: int = 6, scale: int = 2) -> Column:
    """Amount by way of the euro: divided and rounded to the euro's scale, multiplied and rounded to the target's."""
    euro = F.round(amount.cast("decimal(16,4)") / rate_from.cast("decimal(16,8)"), euro_scale)
    return F.round(euro.cast("decimal(20,6)") * rate_to.cast("decimal(16,8)"), scale).cast("decimal(28,2)")


def convert_with(df: DataFrame, rates: DataFrame, amount: str, source: str, target: str) -> DataFrame:
    """``df`` with converted; an unknown currency code is an error. Rates are one row a currency."""
    r = rates.select(F.col("code"), F.col("rate"))
    j = df.join(r.toDF("_c1", "_r1"), F.col(source) == F.col("_c1"), "left").join(r.toDF("_c2", "_r2"), F.col(target) == F.col("_c2"), "left")
    known = F.when(F.col("_r1").isNull() | F.col("_r2").isNull(), F.raise_error("unknown currency code").cast("decimal(28,2)")).otherwise(convert(F.col(amount), F.col("_r1"), F.col("_r2")))
    return j.withColumn("converted", known).drop("_c1", "_r1", "_c2", "_r2")


def _cents(x: Decimal) -> Decimal:
    return x.quantize(Decimal("0.01"), ROUND_HALF_UP)


def annuity(principal: Decimal, rate: Decimal, n: int) -> Decimal:
    """Level payment of n periods at a rate per period, rounded once."""
    if n <= 0:
        raise ValueError("an annuity needs periods")
    if rate == 0:
        return _cents(principal / n)
    factor = Decimal(1)
    for _ in range(n):
        factor *= 1 + rate
    return _cents(principal * rate * factor / (factor - 1))


def schedule(principal: Decimal, rate: Decimal, n: int) -> list[tuple[int, Decimal, Decimal, Decimal, Decimal]]:
    """(period, interest, principal, payment, balance); the last payment settles the rest."""
    level, balance, rows = annuity(principal, rate, n), principal, []
    for k in range(1, n + 1):
        interest = _cents(balance * rate)
        part = balance if k == n else min(level - interest, balance)
        balance -= part
        rows.append((k, interest, part, interest + part, balance))
    return rows


def amortize(loans: DataFrame, id_col: str, principal: str, rate: str, periods: str) -> DataFrame:
    """Rows (id, period, interest, principal, payment, balance) of each loan, a recurrence within one loan's rows."""
    kinds = "id long, period int, interest decimal(18,2), principal decimal(18,2), payment decimal(18,2), balance decimal(18,2)"

    def run(batches):
        getcontext().prec = 28
        for b in batches:
            rows = [(i, *r) for i, p, q, n in zip(*(c.to_pylist() for c in b.columns)) for r in schedule(p, q, n)]
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), *[pa.decimal128(18, 2)] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "period", "interest", "principal", "payment", "balance"])

    return loans.select(F.col(id_col).cast("long"), F.col(principal).cast(MONEY), F.col(rate).cast("decimal(12,10)"), F.col(periods).cast("int")).mapInArrow(run, kinds)


def fixed_point(value: Column, digits: int, scale: int, truncate: bool = False) -> Column:
    """A value as a field of so many digits; outside it an error."""
    power = F.lit(10**scale).cast("decimal(18,0)")
    wide = value.cast(WIDE)
    stored = F.when(wide >= 0, F.floor(wide * power)).otherwise(F.ceil(wide * power)) / power if truncate else F.round(wide, scale)
    most = Decimal(10 ** digits - 1).scaleb(-scale)
    return F.when(F.abs(stored) > F.lit(most), F.raise_error("value outside the field").cast(f"decimal({digits},{scale})")).otherwise(stored.cast(f"decimal({digits},{scale})"))


def is_representable(value: Column, scale: int) -> Column:
    return value.cast(WIDE) == F.round(value.cast(WIDE), scale)
