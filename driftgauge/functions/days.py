"""Capture days read from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capture days in calendar order.
DAY_ORDER = ("monday", "tuesday", "wednesday", "thursday", "friday")
_DAY_PATTERN = r"(?i)(?<![a-zA-Z])(" + "|".join(DAY_ORDER) + r")(?![a-zA-Z])"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def capture_day(path: Column) -> Column:
    """Lower-case weekday named in the file's base name, NULL if there is none."""
    return F.lower(F.nullif(F.regexp_extract(base_name(path), _DAY_PATTERN, 1), F.lit("")))


def day_position(day: Column) -> Column:
    """1-based calendar position, 0 for a day outside the capture week."""
    return F.array_position(F.array(*[F.lit(d) for d in DAY_ORDER]), day)


def tidy_day(day: Column) -> Column:
    return F.lower(F.trim(day.cast("string")))
