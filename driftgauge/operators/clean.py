"""Value cleaning and capture days: projections that keep every row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions import days
from driftgauge.functions.numeric import coerce_number, is_fractional, is_infinite, is_numeric

# Measurements that cannot be negative.
NONNEGATIVE_FEATURES = (
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Fwd Packets Length Total",
    "Bwd Packets Length Total",
    "Fwd Header Length",
    "Bwd Header Length",
)


def _fractional(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    wanted = set(columns) if columns is not None else None
    return [f.name for f in df.schema if is_fractional(f.dataType) and (wanted is None or f.name in wanted)]


def handle_nan_inf(
    df: DataFrame, inf_strategy: str = "to_nan", nan_strategy: str = "flag_only", columns: Sequence[str] | None = None
) -> DataFrame:
    """±Inf and NaN become NULL (``to_nan``) or infinities stay (``keep``); nothing is imputed or dropped."""
    if inf_strategy not in ("to_nan", "keep"):
        raise ValueError(f"unknown inf_strategy {inf_strategy!r}: use 'to_nan' or 'keep'")
    if nan_strategy != "flag_only":
        raise ValueError(f"unknown nan_strategy {nan_strategy!r}: only 'flag_only' exists")
    cleaned = {}
    for name in _fractional(df, columns):
        value = F.col(f"`{name}`")
        bad = F.isnan(value) if inf_strategy == "keep" else F.isnan(value) | is_infinite(value)
        cleaned[name] = F.when(~bad, value)
    return df.withColumns(cleaned) if cleaned else df


def nan_inf_log(df: DataFrame) -> DataFrame:
    """Counts of what :func:`handle_nan_inf` replaces and what is missing afterwards."""
    n_inf, n_missing = F.lit(0).cast("long"), F.lit(0).cast("long")
    for field in df.schema:
        if not is_numeric(field.dataType):
            continue
        value = F.col(f"`{field.name}`")
        if is_fractional(field.dataType):
            n_inf = n_inf + F.count_if(is_infinite(value))
            n_missing = n_missing + F.count_if(value.isNull() | F.isnan(value) | is_infinite(value))
        else:
            n_missing = n_missing + F.count_if(value.isNull())
    counts = df.agg(n_inf.alias("n_inf"), n_missing.alias("n_missing"))
    rows = [
        F.struct(
            F.lit("handle_nan_inf").alias("operator"),
            F.lit(None).cast("string").alias("column"),
            F.col(c).alias("n_affected"),
            F.lit(message).alias("message"),
        )
        for c, message in (("n_inf", "infinite values set to missing"), ("n_missing", "missing values left in place"))
    ]
    return counts.select(F.inline(F.array(*rows)))


def _nonnegative_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    rows = []
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(present):
        raw = F.col(f"`{c}`")
        number = coerce_number(raw)
        aggregates += [
            F.count_if(number < 0).alias(f"negative{i}"),
            F.count_if(raw.isNotNull() & number.isNull()).alias(f"text{i}"),
        ]
        rows.append((c, F.col(f"negative{i}"), F.col(f"text{i}"), "negative values set to missing"))
    for c in columns:
        if c not in present:
            rows.append((c, F.lit(0).cast("long"), F.lit(0).cast("long"), "column absent, skipped"))
    return df.agg(*aggregates).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("validate_nonnegative").alias("operator"),
                        F.lit(c).alias("column"),
                        negative.alias("n_affected"),
                        text.alias("n_not_numeric"),
                        F.lit(message).alias("message"),
                    )
                    for c, negative, text, message in rows
                ]
            )
        )
    )


def nonnegative_log(df: DataFrame, columns: Sequence[str] = NONNEGATIVE_FEATURES) -> DataFrame:
    """Negative values by column; columns that are absent are listed as skipped."""
    return _nonnegative_log(df, columns)


def validate_nonnegative(
    df: DataFrame, columns: Sequence[str] = NONNEGATIVE_FEATURES, check_types: bool = True
) -> DataFrame:
    """Negative values of the listed columns become NULL; rows and columns are kept.

    Text columns are first checked in one job and refused if any value is not a
    number; numeric columns need no such job.
    """
    present = [c for c in columns if c in df.columns]
    textual = [c for c in present if not is_numeric(df.schema[c].dataType)]
    if textual and check_types:
        bad = [r for r in _nonnegative_log(df, textual).collect() if r["n_not_numeric"]]
        if bad:
            raise TypeError(f"non-numeric values in {[(r['column'], r['n_not_numeric']) for r in bad]}")
    cleaned = {}
    for c in present:
        value = F.col(f"`{c}`")
        cleaned[c] = F.when(~F.coalesce(coerce_number(value) < 0, F.lit(False)), value)
    return df.withColumns(cleaned) if cleaned else df


def with_capture_day(df: DataFrame, source_file: str = "source_file", column: str = "capture_day") -> DataFrame:
    """Adds the weekday named in the row's source file; a file without one stops the job."""
    if source_file not in df.columns:
        raise KeyError(f"column {source_file!r} not found; read the table with its source file")
    day = days.capture_day(F.col(source_file))
    refused = F.raise_error(F.concat(F.lit("no capture day in file name: "), F.col(source_file)))
    return df.withColumn(column, F.coalesce(day, refused.cast("string")))


def assign_capture_days(files: DataFrame, source_file: str = "source_file") -> DataFrame:
    """``(source_file, capture_day, detected)`` for each distinct file, in calendar order."""
    day = days.capture_day(F.col(source_file))
    return (
        files.select(source_file)
        .distinct()
        .select(source_file, day.alias("capture_day"), day.isNotNull().alias("detected"))
        .orderBy(days.day_position(F.col("capture_day")), source_file)
    )


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Missing (NULL or NaN) feature values replaced by the given training medians."""
    filled = {}
    for c, median in medians.items():
        value = F.col(f"`{c}`").cast("double")
        if median is None:
            filled[c] = F.nanvl(value, F.lit(None).cast("double"))
        else:
            filled[c] = F.coalesce(F.nanvl(value, F.lit(float(median))), F.lit(float(median)))
    return df.withColumns(filled)
