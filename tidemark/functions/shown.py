"""Numbers and times as text for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"


def _or_missing(value: Column, text: Column) -> Column:
    absent = value.isNull() | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))
    return F.when(absent, MISSING).otherwise(text)


def fixed(value: Column, digits: int = 1) -> Column:
    return _or_missing(value, F.format_string(f"%.{digits}f", value.cast("double")))


def signed(value: Column, digits: int = 1) -> Column:
    """With a plus sign if it is above zero."""
    return _or_missing(value, F.when(value > 0, F.concat(F.lit("+"), fixed(value, digits))).otherwise(fixed(value, digits)))


def percent(value: Column, digits: int = 1) -> Column:
    return _or_missing(value, F.concat(fixed(value * 100, digits), F.lit("%")))


def capital(value: Column) -> Column:
    """Dollars in trillions with two digits, else whole billions or millions."""
    whole = lambda unit, name: F.format_string(f"$%d{name}", F.floor(value / unit + 0.5).cast("long"))
    return F.when(value >= 1e12, F.format_string("$%.2fT", (value / 1e12).cast("double"))).when(value >= 1e9, whole(1e9, "B")).otherwise(whole(1e6, "M"))


def minute(time: Column) -> Column:
    """A time in the session's time zone, to the minute, as UTC."""
    return F.coalesce(F.concat(F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit(MISSING))
