"""Date arithmetic of the sequence format."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_of_birth(year: Column, month: Column, day: Column) -> Column:
    """Missing month or day counts as 1; a day past the month's end runs into the next month."""
    first_of_month = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    return F.date_add(first_of_month, F.coalesce(day, F.lit(1)) - 1)


def week_index(date: Column) -> Column:
    """Whole weeks since 1970-01-01 (truncated towards that day)."""
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.call_function("div", days, F.lit(7).cast("bigint"))


def age_in_months(birth: Column, date: Column) -> Column:
    """Calendar-month boundaries between birth and the date; days within a month do not count."""
    months = (F.year(date) - F.year(birth)) * 12 + F.month(date) - F.month(birth)
    return months.cast("bigint")


def month_number(date: Column) -> Column:
    """Months since year 0: a coarse, order-preserving part of a date, used to split hot groups."""
    return F.year(date) * 12 + F.month(date)


def interval_token(days: Column) -> Column:
    """The gap between two visits as a token."""
    return (
        F.when(days < 0, F.lit("W-1"))
        .when(days < 28, F.concat(F.lit("W"), F.floor(days / 7).cast("string")))
        .when(days < 360, F.concat(F.lit("M"), F.floor(days / 30).cast("string")))
        .otherwise(F.lit("LT"))
    )
