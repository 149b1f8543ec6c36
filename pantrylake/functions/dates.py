"""Date expressions. Nothing here reads the clock: callers give the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def biweekly_bucket(day: Column, anchor: str = "2026-01-05") -> Column:
    """The Monday that starts the 14 days around `day`, counted from an anchor Monday."""
    start = F.lit(anchor).cast("date")
    return F.date_add(start, (F.floor(F.datediff(day, start) / 14) * 14).cast("int"))


def prep_date(day: Column) -> Column:
    """The day before; never on a weekend."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def parse_date(c: Column, patterns: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("date") for p in patterns])


def plausible(day: Column, as_of: Column) -> Column:
    """Null unless within 548 days before and 7 days after `as_of`."""
    return F.when(day.between(F.date_sub(as_of, 548), F.date_add(as_of, 7)), day)


def elapsed_share(day: Column) -> Column:
    return F.dayofmonth(day) / F.dayofmonth(F.last_day(day))


def week_of_month(day: Column) -> Column:
    return F.concat(F.lit("Week "), F.ceil(F.dayofmonth(day) / 7).cast("string"))
