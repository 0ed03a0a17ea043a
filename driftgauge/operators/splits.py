"""Splits in time and the checks that prove they do not leak."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import names
from driftgauge.functions.days import DAY_ORDER, tidy_day
from driftgauge.operators.order_stats import content_order, copies, order_cuts
from driftgauge.session import literal_table

VALIDATION_DAYS = ("thursday",)
SUBTRAIN_DAYS = ("monday", "tuesday", "wednesday")


class LeakageError(RuntimeError):
    """A split lets test information reach training."""


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame
    column: str
    train_days: tuple[str, ...] = ()
    test_days: tuple[str, ...] = ()
    #: Microseconds since 1970 of the last training row, where the split was cut in time: no row is beyond it on the wrong side.
    edge: int | None = None


def as_timestamp(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text that is not one becomes NULL."""
    value = F.col(f"`{column}`")
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(dtype, T.DateType):
        return value.cast("timestamp_ntz")
    return F.try_to_timestamp(value.cast("string"))


def as_microseconds(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970, in an order no time zone can change for zone-free timestamps."""
    moment = as_timestamp(df, column)
    if _is_zone_free(df, column):
        since = moment - F.lit("1970-01-01").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(20,6)") * F.lit(1_000_000)).cast("long")
    return F.unix_micros(moment.cast("timestamp"))


def _is_zone_free(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampNTZType, T.DateType))


def _moment_literal(df: DataFrame, column: str, value) -> Column:
    """A collected moment, or microseconds since 1970, as a literal of the column's own kind."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz" if _is_zone_free(df, column) else "timestamp")
    if _is_zone_free(df, column):
        if isinstance(value, int):
            value = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value)
        return F.lit(str(value)).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(value)) if isinstance(value, int) else F.lit(value)


def detect_timestamp_column(df: DataFrame, explicit: str | None = None) -> DataFrame:
    """One row: chosen column (or NULL), candidates, unparseable values, whether any value parses."""
    if explicit is not None and explicit not in df.columns:
        raise KeyError(f"timestamp column {explicit!r} not found in {df.columns}")
    candidates = [explicit] if explicit else names.timestamp_candidates(df.columns)
    if not candidates:
        return literal_table(
            df.sparkSession,
            [(None, [], 0, 0, False)],
            "column string, candidates array<string>, n_values bigint, n_unparseable bigint, parsed boolean",
        )
    column = candidates[0]
    value, parsed = F.col(f"`{column}`"), as_timestamp(df, column)
    return df.agg(
        F.count(value).alias("n_values"),
        F.count_if(value.isNotNull() & parsed.isNull()).alias("n_unparseable"),
    ).select(
        F.lit(column).alias("column"),
        F.array(*[F.lit(c) for c in candidates]).alias("candidates"),
        "n_values",
        "n_unparseable",
        ((F.col("n_values") > 0) & (F.col("n_unparseable") < F.col("n_values"))).alias("parsed"),
    )


def chronological_split(
    df: DataFrame, timestamp: str, test_size: float = 0.2, row_key: Sequence[str] | str | None = None
) -> Split:
    """The earliest ``n - round(n * test_size)`` rows train, the rest test.

    Rows with one timestamp are ordered by ``row_key`` (numeric columns), then by
    their content, so the outcome does not depend on how the rows are stored. The
    cut is found as a rank, and both sides are filters on it: no row is moved or sorted.
    """
    if timestamp not in df.columns:
        raise KeyError(f"timestamp column {timestamp!r} not found")
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must lie strictly between 0 and 1, got {test_size}")
    moment = as_timestamp(df, timestamp)
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(moment.isNull()).alias("bad")).first()
    n = sizes["n"]
    if n == 0:
        raise ValueError("cannot split an empty table")
    if sizes["bad"]:
        raise ValueError(f"{sizes['bad']} rows have no readable timestamp in {timestamp!r}")
    size = min(max(round(n * (1.0 - test_size)), 1), n - 1)

    keys = [row_key] if isinstance(row_key, str) else list(row_key or [])
    columns = df.columns
    ordered = content_order(df).withColumns(
        {"_micros": as_microseconds(df, timestamp), "_all": F.lit(0)}
    )
    order = ["_micros", *keys, "_order_1", "_order_2"]
    if size == 0:
        return Split(df.limit(0), df, timestamp)
    cut = order_cuts(ordered, "_all", {0: size}, order)[0]
    kept = [F.col(f"`{c}`") for c in columns]
    # Implied by the cut, but in a form the scan can use to skip files and row groups.
    cut_at = int(cut.path[0][1])
    edge = _moment_literal(df, timestamp, cut_at)
    early, late = ordered.where(moment <= edge), ordered.where(moment >= edge)
    if not cut.splits_ties:
        return Split(early.where(cut.taken()).select(*kept), late.where(~cut.taken()).select(*kept), timestamp, edge=cut_at)
    # Equal rows on both sides of the cut: which copies go where makes no difference.
    same = ordered.where(cut.at()).groupBy(*kept).agg(F.count(F.lit(1)).alias("_copies"))
    train_tail = copies(same.withColumn("_copies", F.lit(cut.ties).cast("long")), "_copies")
    test_head = copies(same.withColumn("_copies", F.col("_copies") - cut.ties), "_copies")
    return Split(
        early.where(cut.before()).select(*kept).unionByName(train_tail),
        late.where(~(cut.before() | cut.at())).select(*kept).unionByName(test_head),
        timestamp,
        edge=cut_at,
    )


def split_bounds(split: Split) -> DataFrame:
    """One row: sizes and first/last timestamps of both sides."""
    def side(df, name):
        moment = as_timestamp(df, split.column)
        return df.agg(
            F.count(F.lit(1)).alias(f"n_{name}"),
            F.min(moment).alias(f"{name}_start"),
            F.max(moment).alias(f"{name}_end"),
        )

    return side(split.train, "train").crossJoin(side(split.test, "test"))


def _edge_facts(split: Split):
    """Both sides' ends, and their rows at and beyond the split's edge, in one pass over both."""
    edge = _moment_literal(split.train, split.column, split.edge)
    sides = [df.select(as_timestamp(df, split.column).alias("moment"), F.lit(t).alias("train")) for df, t in ((split.train, True), (split.test, False))]
    moment, train = F.col("moment"), F.col("train")
    return sides[0].unionByName(sides[1]).agg(
        F.max(F.when(train, moment)).alias("train_end"), F.min(F.when(~train, moment)).alias("test_start"),
        F.count_if(train & (moment == edge)).alias("train_rows"), F.count_if(~train & (moment == edge)).alias("test_rows"),
        F.count_if(F.when(train, moment > edge).otherwise(moment < edge)).alias("beyond"),
    ).first()


def check_time_leakage(split: Split) -> DataFrame:
    """One row: whether training ends before testing starts and no timestamp is on both sides.

    A split that knows its edge is read once: if no row is beyond the edge, only the edge itself can be on both sides.
    Otherwise a shared timestamp can only lie between the first test and the last training
    moment, so only rows in that range are grouped: none at all in a clean split.
    """
    if split.edge is not None:
        facts = _edge_facts(split)
        if not facts["beyond"]:
            shared = facts["train_rows"] > 0 and facts["test_rows"] > 0
            known = facts["train_end"] is not None and facts["test_start"] is not None
            end, start = (_moment_literal(split.train, split.column, facts[c]) for c in ("train_end", "test_start"))
            return split.train.sparkSession.range(1).select(
                F.lit(known and not shared).alias("passed"), F.lit(known).alias("order_ok"), end.alias("train_end"), start.alias("test_start"),
                F.lit(int(shared)).cast("long").alias("n_shared_timestamps"),
                F.lit(facts["train_rows"] + facts["test_rows"] if shared else 0).cast("long").alias("n_overlapping_rows"),
            )
    column = split.column
    bounds = split_bounds(split).first()
    last_train, first_test = bounds["train_end"], bounds["test_start"]
    end, start = (_moment_literal(split.train, column, v) for v in (last_train, first_test))

    def in_range(df, side):
        moment = as_timestamp(df, column)
        return df.where((moment >= start) & (moment <= end)).select(
            moment.alias("moment"), F.lit(side).alias("side")
        )

    shared = (
        in_range(split.train, "train")
        .unionByName(in_range(split.test, "test"))
        .groupBy("moment")
        .agg(
            F.count_if(F.col("side") == "train").alias("train_rows"),
            F.count_if(F.col("side") == "test").alias("test_rows"),
        )
        .where("train_rows > 0 AND test_rows > 0")
    )
    order_ok = last_train is not None and first_test is not None and last_train <= first_test
    return shared.agg(
        F.count(F.lit(1)).alias("n_shared_timestamps"),
        F.coalesce(F.sum(F.col("train_rows") + F.col("test_rows")), F.lit(0)).alias("n_overlapping_rows"),
    ).select(
        (F.lit(order_ok) & (F.col("n_overlapping_rows") == 0)).alias("passed"),
        F.lit(order_ok).alias("order_ok"),
        end.alias("train_end"),
        start.alias("test_start"),
        "n_shared_timestamps",
        "n_overlapping_rows",
    )


def _known_days(days: Sequence[str], which: str) -> list[str]:
    tidy = [str(d).strip().lower() for d in days]
    unknown = [d for d in tidy if d not in DAY_ORDER]
    if unknown:
        raise ValueError(f"unknown day in {which}: {unknown}; expected some of {DAY_ORDER}")
    return tidy


def present_days(df: DataFrame, day: str = "capture_day") -> list[str]:
    """The capture days in the table, in calendar order; other values are ignored."""
    found = {r[0] for r in df.select(tidy_day(F.col(f"`{day}`")).alias("d")).where(F.col("d").isin(*DAY_ORDER)).distinct().collect()}
    return [d for d in DAY_ORDER if d in found]


def day_split(
    df: DataFrame, test_days: Sequence[str], train_days: Sequence[str] | None = None, day: str = "capture_day"
) -> Split:
    """Hold out whole days; every test day must come after every training day."""
    if day not in df.columns:
        raise KeyError(f"day column {day!r} not found")
    test_days = _known_days(test_days, "test_days")
    present = present_days(df, day)
    if train_days is None:
        train_days = [d for d in present if d not in test_days]
    else:
        train_days = _known_days(train_days, "train_days")
    both = sorted(set(train_days) & set(test_days))
    if both:
        raise ValueError(f"days on both sides: {both}")
    if not train_days or not test_days:
        raise ValueError(f"both sides need days: train {train_days}, test {test_days}")
    if min(map(DAY_ORDER.index, test_days)) <= max(map(DAY_ORDER.index, train_days)):
        raise ValueError(f"every test day must follow every training day: train {train_days}, test {test_days}")
    for side, days in (("train", train_days), ("test", test_days)):
        if not set(days) & set(present):
            raise ValueError(f"no rows for {side} days {days}")
    value = tidy_day(F.col(f"`{day}`"))
    return Split(
        df.where(value.isin(*train_days)), df.where(value.isin(*test_days)), day, tuple(train_days), tuple(test_days)
    )


def check_day_leakage(split: Split) -> DataFrame:
    """One row: no shared day and every test day later, judged on the rows' own days.
    Days outside the capture week are ignored."""
    def side(df, name):
        return df.select(tidy_day(F.col(f"`{split.column}`")).alias("day"), F.lit(name).alias("side")).distinct()

    position = F.array_position(F.array(*[F.lit(d) for d in DAY_ORDER]), F.col("day"))
    days = side(split.train, "train").unionByName(side(split.test, "test")).withColumn("position", position).where("position > 0")
    both = days.groupBy("day").agg(F.count(F.lit(1)).alias("sides"), F.max("position").alias("position"),
                                   F.max("side").alias("last"), F.min("side").alias("first"))
    is_train, is_test = F.col("last") == "train", F.col("first") == "test"
    return both.agg(
        F.array_sort(F.collect_list(F.when(is_train, F.col("position")))).alias("train_positions"),
        F.array_sort(F.collect_list(F.when(is_test, F.col("position")))).alias("test_positions"),
        F.count_if(F.col("sides") > 1).alias("n_shared_days"),
        F.max(F.when(is_train, F.col("position"))).alias("last_train"),
        F.min(F.when(is_test, F.col("position"))).alias("first_test"),
    ).select(
        F.coalesce((F.col("n_shared_days") == 0) & (F.col("first_test") > F.col("last_train")), F.lit(False)).alias("passed"),
        F.coalesce(F.col("first_test") > F.col("last_train"), F.lit(False)).alias("order_ok"),
        "n_shared_days",
        F.transform("train_positions", _day_name).alias("train_days"),
        F.transform("test_positions", _day_name).alias("test_days"),
    )


def _day_name(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_ORDER]), position.cast("int"))


def require(check: DataFrame, what: str) -> None:
    """Raise if a one-row check did not pass."""
    row = check.first()
    if not row["passed"]:
        raise LeakageError(f"{what} failed: {row.asDict()}")


def validation_split(
    train: DataFrame,
    validation_days: Sequence[str] = VALIDATION_DAYS,
    subtrain_days: Sequence[str] | None = SUBTRAIN_DAYS,
    day: str = "capture_day",
) -> Split:
    """Sub-training and validation days inside the training period, with the day check enforced."""
    split = day_split(train, validation_days, subtrain_days, day)
    require(check_day_leakage(split), "validation split day check")
    return split


def split_in_time(
    df: DataFrame,
    features: Sequence[str],
    test_size: float = 0.2,
    test_days: Sequence[str] = ("friday",),
    day: str = "capture_day",
    timestamp: str | None = None,
    row_key: str | None = None,
) -> tuple[Split, list[str], str]:
    """By row timestamp if one parses, else by capture day; the split column leaves the features."""
    found = detect_timestamp_column(df, timestamp).first()
    if found["parsed"]:
        split = chronological_split(df, found["column"], test_size, row_key)
        require(check_time_leakage(split), "time leakage check")
        method = "timestamp"
    elif day in df.columns:
        split = day_split(df, test_days, day=day)
        require(check_day_leakage(split), "day leakage check")
        method = "capture_day"
    else:
        raise ValueError("neither a readable timestamp column nor a capture day to split on")
    left_out = {split.column, day}
    return split, [f for f in features if f not in left_out], method


def day_label_table(df: DataFrame, label: str, day: str = "capture_day") -> DataFrame:
    """Rows of each capture day and label as a cross table, days in calendar order."""
    labels = sorted(r[0] for r in df.select(F.col(f"`{label}`").cast("string")).distinct().collect() if r[0] is not None)
    value = tidy_day(F.col(f"`{day}`"))
    return (
        df.where(value.isin(*DAY_ORDER))
        .groupBy(value.alias("capture_day"))
        .pivot(label, labels)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .orderBy(F.array_position(F.array(*[F.lit(d) for d in DAY_ORDER]), F.col("capture_day")))
    )
