"""Dates from texts, day differences and aging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish month names and their numbers.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}


def parse_date(text: Column) -> Column:
    """ISO, or day/month/year with `/` or `-` and two or four digits of year; else null."""
    iso = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    day, month, year = (F.regexp_extract(text, r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\b", i) for i in (1, 2, 3))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    made = F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(F.when(iso != "", iso).try_cast("date"), F.when(day != "", made).try_cast("date"))


def parse_spanish_date(text: Column, fallback_year: int) -> Column:
    """`05 junio 2026`, `08 junio` (year as given) or day/month/year; else null."""
    pattern = r"(?i)(\d{1,2})\s+([a-záéíóú]+)\s*(\d{4})?"
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(names, F.lower(F.regexp_extract(text, pattern, 2)))
    year = F.coalesce(F.regexp_extract(text, pattern, 3).try_cast("int"), F.lit(fallback_year))
    made = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"))
    return F.coalesce(F.when(month.isNotNull(), made).try_cast("date"), parse_date(text))


def with_time(day: Column, clock: Column) -> Column:
    """A day and `HH:MM[:SS]` as a timestamp; without a clock, midnight."""
    fine = F.when(clock.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.when(F.length(clock) <= 5, F.concat(clock, F.lit(":00"))).otherwise(clock)).otherwise("00:00:00")
    return F.concat_ws(" ", day.cast("string"), F.lpad(fine, 8, "0")).try_cast("timestamp_ntz")


def aging_bucket(since: Column, until: Column) -> Column:
    """Days from `since` to `until` (0 at least) as 0-7, 8-30, 31-60 or 60+."""
    days = F.greatest(F.datediff(until, since), F.lit(0))
    return F.when(days <= 7, "0-7").when(days <= 30, "8-30").when(days <= 60, "31-60").otherwise("60+")


def sheet_serial(day: Column) -> Column:
    """The day number of spreadsheets."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + 25569
