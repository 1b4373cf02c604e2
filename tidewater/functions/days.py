"""Calendar days written in several notations, and period numbers of daily and weekday calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, the no-break spaces included (Java class without the UNICODE flag needs them named).
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_space(c: Column) -> Column:
    """``c`` without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def parse_day(c: Column) -> Column:
    """The DATE of a day written as yyyy-MM-dd, yyyy/MM/dd, yyyyMMdd, an ISO instant, or d MMM yyyy; NULL if unreadable."""
    s = strip_space(c)
    digits = F.regexp_replace(F.substring(s, 1, 10), r"[-/]", "")
    numeric = F.substring(digits, 1, 8)
    instant = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?")
    return (
        F.when(instant, F.try_to_timestamp(s).cast("date"))
        .when(s.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$") | s.rlike(r"^\d{8}$"), F.try_to_timestamp(numeric, F.lit("yyyyMMdd")).cast("date"))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_timestamp(s, F.lit("d MMM yyyy")).cast("date"))
        .otherwise(F.lit(None).cast("date"))
    )


def day_number(day: Column) -> Column:
    """Days since 1970-01-01 of a DATE."""
    return F.unix_date(day)


def weekday_number(day: Column) -> Column:
    """Consecutive numbers of the days from Monday to Friday; NULL on Saturday and Sunday. Monday 1969-12-29 is 0."""
    shifted = F.unix_date(day) + F.lit(3)
    dow = F.pmod(shifted, F.lit(7))
    return F.when(dow < 5, F.floor(shifted / 7).cast("int") * 5 + dow).cast("int")


def day_text(number: Column, calendar: Column) -> Column:
    """The day yyyy-MM-dd of a period number in the calendar ``daily`` or ``weekdays``."""
    weekday = F.floor(number / 5).cast("int") * 7 + F.pmod(number, F.lit(5)) - 3
    return F.date_format(F.date_from_unix_date(F.when(calendar == "weekdays", weekday).otherwise(number).cast("int")), "yyyy-MM-dd")


def figure(c: Column) -> Column:
    """A figure as DOUBLE; NaN and the infinities are none."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)
