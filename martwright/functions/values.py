"""Literals, exact money, guarded division and status words."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status words of a check or run, from best to worst.
PASSED, WARNING, FAILED, ERROR = "passed", "warning", "failed", "error"
STATUSES = (PASSED, WARNING, FAILED, ERROR)

# Points a check adds to the trust score.
SCORE_POINTS = {PASSED: 1.0, WARNING: 0.5, FAILED: 0.0, ERROR: 0.0}


def instant(value: datetime) -> Column:
    """Zone-free timestamp literal. ``as_of`` always enters a plan this way, never as a clock."""
    return F.expr(f"TIMESTAMP_NTZ'{value:%Y-%m-%d %H:%M:%S.%f}'")


def day_literal(value: date) -> Column:
    return F.expr(f"DATE'{value:%Y-%m-%d}'")


def moment(df: DataFrame, column: str, value: date) -> Column:
    """Literal in the type of ``column``, so that a comparison reaches the parquet scan."""
    dtype = df.schema[column].dataType.typeName()
    at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return day_literal(at) if dtype == "date" else instant(at)


def within(df: DataFrame, column: str, start: date | None, end: date | None) -> Column:
    """Half-open span ``[start, end)``; either bound may be absent."""
    test = F.lit(True)
    if start is not None:
        test = F.col(column) >= moment(df, column, start)
    if end is not None:
        upper = F.col(column) < moment(df, column, end)
        test = upper if start is None else test & upper
    return test


def money(column: Column | str, precision: int = 12, scale: int = 2) -> Column:
    """Exact decimal amount: sums do not depend on the order of the rows."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast(f"decimal({precision},{scale})")


def scaled(df: DataFrame, column: str, digits: int) -> DataFrame:
    """State that a floating column holds whole multiples of 10^-digits.

    Sums of such a column are exact and do not depend on row order. Nothing is rounded
    without this statement: other floating columns are summed as they are.
    """
    return df.withMetadata(column, {**df.schema[column].metadata, "digits": digits})


def scale_of(df: DataFrame, column: str, digits: int | None = None) -> int | None:
    """The decimal places stated for a floating column; None for other types."""
    field = df.schema[column]
    if field.dataType.typeName() not in ("double", "float"):
        return None
    return field.metadata.get("digits") if digits is None else digits


def whole(df: DataFrame, column: str, digits: int | None = None) -> tuple[Column, float]:
    """A column with a stated scale as integers of 10^-digits, with the divisor that undoes it.

    Values that are no such number (NaN, or beyond a bigint) raise; any other
    column stays as it is.
    """
    digits = scale_of(df, column, digits)
    if digits is None:
        return F.col(column), 1.0
    scale = float(10**digits)
    return F.rint(F.col(column).cast("double") * scale).cast("bigint"), scale


# A sum of bigints is kept as two sums, of the low bits and of the rest.
_LOW_BITS = 24


def total(
    df: DataFrame, column: str, when: Column | None = None, digits: int | None = None
) -> Column:
    """Aggregate: sum of a column (where a condition holds) as a double.

    With a stated scale integers are summed, in two halves that 10^11 rows cannot overflow;
    a NaN, or an amount beyond a bigint, among the rows makes the sum NaN.
    """
    digits = scale_of(df, column, digits)
    if digits is None:
        value = F.col(column)
        return F.sum(value if when is None else F.when(when, value)).cast("double")
    scale = float(10**digits)
    units = F.col(column).cast("double") * scale
    fits = F.abs(units) < F.lit(2.0**62)
    counted = fits if when is None else when & fits
    unit = F.rint(units).cast("bigint")
    high = F.sum(F.when(counted, F.shiftright(unit, _LOW_BITS))).cast("decimal(20,0)")
    low = F.sum(F.when(counted, unit.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))).cast("decimal(20,0)")
    odd = ~fits if when is None else when & ~fits
    exact = (high * F.lit(Decimal(1 << _LOW_BITS)) + low) * F.lit(Decimal(1).scaleb(-digits))
    return F.when(F.max(odd), F.lit(float("nan"))).otherwise(exact.cast("double"))


def exact_decimal(df: DataFrame, column: str, digits: int | None = None) -> Column:
    """Aggregate: the same sum as a decimal, for amounts that are summed up further.

    Without a stated scale it is the plain sum.
    """
    value, scale = whole(df, column, digits)
    if scale == 1.0:
        return F.sum(value)
    places = scale_of(df, column, digits)
    return F.sum(value).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))


def month_of(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.trunc(column.cast("date"), "month")


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL instead of a division by zero."""
    return F.try_divide(numerator.cast("double"), denominator)


def percent(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(F.lit(100.0) * numerator, denominator)


def rounded(value: Column, digits: int) -> Column:
    """Round a double by scaling it, half away from zero; decimals use ``F.round`` as they are."""
    scale = F.lit(float(10**digits))
    return F.round(value.cast("double") * scale) / scale


def change_percent(current: Column, previous: Column) -> Column:
    """Signed change against the previous value on the 0-100 scale; NULL without a baseline."""
    return percent(current - previous, previous)


def severity(status: Column) -> Column:
    """Rank of a status word, worst highest."""
    rank = F.lit(STATUSES.index(ERROR))
    for position, word in enumerate(STATUSES[:-1]):
        rank = F.when(status == word, position).otherwise(rank)
    return rank


def worst_status(status: Column) -> Column:
    """Aggregate: the worst status of the group."""
    words = F.array(*[F.lit(word) for word in STATUSES])
    return F.element_at(words, F.max(severity(status)) + 1)


def score_points(status: Column) -> Column:
    points = F.lit(0.0)
    for word, value in SCORE_POINTS.items():
        points = F.when(status == word, value).otherwise(points)
    return points


def short_status(status: Column) -> Column:
    """Display word: pass, warn or fail; anything unknown reads as warn."""
    word = F.lower(F.coalesce(status, F.lit("unknown")))
    return (
        F.when(word.isin("passed", "pass"), "pass")
        .when(word.isin("warning", "warn"), "warn")
        .when(word.isin("failed", "fail", "error"), "fail")
        .otherwise("warn")
    )


def dedup_key(kind: Column, title: Column) -> Column:
    """Twelve hex digits that identify an issue by kind and title."""
    return F.substring(F.sha1(F.concat_ws("::", kind, title)), 1, 12)
