"""Exact ranks, quantiles and order cuts without sorting a whole column.

Spark's exact ``median`` keeps every distinct value of a group in one
aggregation buffer, and an ordered window keeps a whole group in one task. Here
ranks are selected digit by digit: each pass cuts the brackets of values that hold
wanted ranks into cells, first by sign and binary exponent, then evenly, and one aggregate
counts the rows of every cell and their least and largest value, which are the next
bracket. A bracket of one value is an answer, however many rows have it; one of at most
``limit`` rows is ranked. Cells keep the order of values, so nothing is estimated. Every
pass is one scan with map-side aggregation, and there are eight at most. The driver sees one
row for each wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions.numeric import finite, order_hash
from driftgauge.session import literal_table, settle

IN_BRACKET_LIMIT = 1_000_000
#: Cells of an even pass: ten bits of what doubles of one exponent differ in.
_CELLS, _FINE_CELLS = 1 << 10, 1 << 14
_EXPONENTS = 1100


@dataclass(frozen=True)
class Bracket:
    """The ``count`` values of one group from ``low`` to ``high``; ``below`` values of the group are less."""

    key: tuple
    low: float
    high: float
    below: int
    count: int

    def by_exponent(self, even: bool) -> bool:
        """Whether cells follow sign and exponent: the ends are a factor of 4 apart at least, or 0 is between."""
        if even:
            return False
        return self.low <= 0 <= self.high or max(abs(self.low), abs(self.high)) > 4 * min(abs(self.low), abs(self.high))


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., feature, value)`` with finite values only; one pass, no shuffle."""
    values = [F.struct(F.lit(c).alias("feature"), finite(F.col(f"`{c}`")).alias("value")) for c in columns]
    return (
        df.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.array(*values)))
        .where(F.col("value").isNotNull())
    )


def _key_matches(keys: Sequence[str], key: tuple) -> Column:
    tests = [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(keys, key)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _bracket_table(long: DataFrame, keys: Sequence[str], brackets: Sequence[Bracket], even: bool) -> DataFrame:
    schema = T.StructType(
        [T.StructField(f"_k_{k}", long.schema[k].dataType) for k in keys]
        + [T.StructField("_bracket", T.IntegerType(), False)]
        + [T.StructField(c, T.DoubleType()) for c in ("_low", "_high")]
        + [T.StructField("_by_exponent", T.BooleanType(), False)]
    )
    rows = [(*b.key, i, b.low, b.high, b.by_exponent(even)) for i, b in enumerate(brackets)]
    return literal_table(long.sparkSession, rows, schema)


def _join_on(keys: Sequence[str]) -> Column:
    tests = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in keys]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _inside(long: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """Rows of ``long`` once for each bracket that holds them; brackets of a group don't overlap."""
    return long.join(brackets, _join_on(keys)).where(F.col("value").between(F.col("_low"), F.col("_high")))


def _cell(cells: int) -> Column:
    """A number that never falls as the value rises, and differs for the two ends of a bracket."""
    value, low, high = F.col("value"), F.col("_low"), F.col("_high")
    exponent = F.floor(F.log2(F.abs(value))) + _EXPONENTS
    signed = F.when(value == 0, F.lit(0)).when(value > 0, exponent).otherwise(-exponent)
    even = F.least(F.floor((value - low) / (high - low) * cells), F.lit(cells - 1))
    return F.when(F.col("_by_exponent"), signed).otherwise(even)


def _ranked_cells(cells: DataFrame, brackets: Sequence[Bracket], ranks: Sequence[tuple[int, int]], order: str) -> DataFrame:
    """The rows of ``cells`` (_bracket, order, _count, ...) that hold ``ranks`` (bracket, rank in the group), with ``_rank``, the
    place in ``ranks``, and ``_since``, how many of the group come before."""
    wanted = literal_table(
        cells.sparkSession, [(b, i, r, brackets[b].below) for i, (b, r) in enumerate(ranks)],
        "_bracket int, _rank int, _position long, _below long",
    )
    upto = F.sum("_count").over(Window.partitionBy("_bracket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumn("_upto", upto).join(wanted, "_bracket").withColumn("_since", F.col("_below") + F.col("_upto") - F.col("_count"))
    return placed.where((F.col("_since") <= F.col("_position")) & (F.col("_position") < F.col("_since") + F.col("_count")))


def _narrowed(long: DataFrame, keys: Sequence[str], brackets: list[Bracket], ranks: list[tuple[int, int]], even: bool) -> list[Bracket]:
    """The cell of each of ``ranks`` (bracket, rank in the group), as a bracket."""
    table = _bracket_table(long, keys, brackets, even)
    cells = (
        _inside(long, keys, table).groupBy("_bracket", _cell(_FINE_CELLS if even else _CELLS).alias("_cell"))
        .agg(F.count("value").alias("_count"), F.min("value").alias("_least"), F.max("value").alias("_most"))
    )
    out: dict[int, Bracket] = {}
    for r in _ranked_cells(cells, brackets, ranks, "_cell").collect():
        out[r["_rank"]] = Bracket(brackets[r["_bracket"]].key, r["_least"], r["_most"], r["_since"], r["_count"])
    return [out[i] for i in range(len(ranks))]


def locate(
    long: DataFrame,
    keys: Sequence[str],
    wanted: Callable[[Row, int], Sequence[tuple[str, float]]],
    limit: int = IN_BRACKET_LIMIT,
    even: bool = False,
) -> DataFrame:
    """Exact values at wanted positions of each group of ``long(keys..., value)``.

    ``wanted(group, n)`` names 0-based positions among the group's ``n`` values; a
    fractional position is interpolated between its neighbours. Returns
    ``(keys..., name, value, n_before, n_equal)`` where the last two count the
    rows before and at the (lower) position. Group keys must be few: one row each
    is brought to the driver. ``even`` says that values should be spread evenly over their range,
    as hashes are; it only saves passes, the result never depends on it.
    """
    value = F.col("value")
    key_columns = [F.col(f"`{k}`") for k in keys]
    held: dict[tuple[tuple, int], Bracket] = {}
    items: list[tuple[tuple, str, int, int, float]] = []
    for group in long.groupBy(*key_columns).agg(F.count("value").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")).collect():
        n = group["_n"]
        key = tuple(group[k] for k in keys)
        for name, position in wanted(group, n) if n else ():
            low = min(max(math.floor(position), 0), n - 1)
            high = min(max(math.ceil(position), 0), n - 1)
            items.append((key, name, low, high, position - math.floor(position)))
            for rank in (low, high):
                held[key, rank] = Bracket(key, group["_low"], group["_high"], 0, n)

    narrowed = False
    while open_ranks := [at for at, b in held.items() if b.count > limit and b.low < b.high]:
        brackets = list(dict.fromkeys(held[at] for at in open_ranks))
        number = {b: i for i, b in enumerate(brackets)}
        ranks = [(number[held[at]], at[1]) for at in open_ranks]
        held.update(zip(open_ranks, _narrowed(long, keys, brackets, ranks, even)))
        narrowed = True

    told = T.StructType(
        [T.StructField("_item", T.IntegerType(), False), T.StructField("_upper", T.BooleanType(), False), T.StructField("value", T.DoubleType())]
        + [T.StructField(c, T.LongType(), False) for c in ("_since", "_count")]
    )
    ends = [(i, upper, held[key, rank], rank) for i, (key, _, low, high, _) in enumerate(items) for upper, rank in ((False, low), (True, high))]
    found = literal_table(long.sparkSession, [(i, u, b.low, b.below, b.count) for i, u, b, _ in ends if b.low == b.high], told)
    ranked = [e for e in ends if e[2].low != e[2].high]
    if ranked:
        brackets = list(dict.fromkeys(b for _, _, b, _ in ranked))
        number = {b: i for i, b in enumerate(brackets)}
        table = _bracket_table(long, keys, brackets, even)
        if narrowed:
            cells = _inside(long, keys, table).groupBy("_bracket", "value").agg(F.count("value").alias("_count"))
        else:  # whole groups: rows are counted before anything is joined
            counted = long.where(value.isNotNull()).groupBy(*key_columns, "value").agg(F.count("value").alias("_count"))
            cells = counted.join(table, _join_on(keys)).select("_bracket", "value", "_count")
        names = literal_table(
            long.sparkSession, [(r, i, u) for r, (i, u, _, _) in enumerate(ranked)], "_rank int, _item int, _upper boolean"
        )
        placed = _ranked_cells(cells, brackets, [(number[b], rank) for _, _, b, rank in ranked], "value").join(names, "_rank")
        found = found.unionByName(placed.select("_item", "_upper", "value", "_since", "_count"))

    schema = T.StructType(
        [T.StructField("_item", T.IntegerType(), False), T.StructField("name", T.StringType(), False), T.StructField("_fraction", T.DoubleType(), False)]
        + [T.StructField(k, long.schema[k].dataType) for k in keys]
    )
    asked = literal_table(long.sparkSession, [(i, name, fraction, *key) for i, (key, name, _, _, fraction) in enumerate(items)], schema)
    pairs = found.groupBy("_item").agg(
        F.max(F.when(~F.col("_upper"), value)).alias("_low"), F.max(F.when(F.col("_upper"), value)).alias("_high"),
        F.max(F.when(~F.col("_upper"), F.col("_since"))).alias("n_before"), F.max(F.when(~F.col("_upper"), F.col("_count"))).alias("n_equal"),
    )
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_fraction"))
    return pairs.join(asked, "_item").select(*key_columns, "name", between.alias("value"), "n_before", "n_equal")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: dict[str, float],
    by: Sequence[str] = (),
    limit: int = IN_BRACKET_LIMIT,
) -> DataFrame:
    """``(by..., feature, <one column per quantile>)``, linear interpolation, missing skipped."""
    group = [F.col(f"`{b}`") for b in by]
    values = {c: finite(F.col(f"`{c}`")) for c in columns}
    sizes = df.groupBy(*group).agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())])
    largest = max((sum(r[len(by):]) for r in sizes.collect()), default=0)
    if largest <= limit:
        # Few enough values in every group, all columns together, for the built-in exact percentile.
        at = F.array(*[F.lit(float(q)) for q in quantiles.values()])
        found = df.groupBy(*group).agg(*[F.percentile(v, at).alias(f"q{i}") for i, v in enumerate(values.values())])
        rows = [
            F.struct(
                F.lit(c).alias("feature"),
                *[F.get(F.col(f"q{i}"), F.lit(j)).alias(name) for j, name in enumerate(quantiles)],
            )
            for i, c in enumerate(columns)
        ]
        return found.select(*group, F.inline(F.array(*rows))).where(F.col(next(iter(quantiles))).isNotNull())

    keys = [*by, "feature"]

    def positions(_, n: int):
        return [(name, q * (n - 1)) for name, q in quantiles.items()]

    found = locate(to_long(df, columns, by), keys, positions, limit)
    return found.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles]
    )


def column_medians(df: DataFrame, columns: Sequence[str], limit: int = IN_BRACKET_LIMIT) -> DataFrame:
    """``(feature, median)`` over the rows where the feature is present."""
    return exact_quantiles(df, columns, {"median": 0.5}, limit=limit)


def collect_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians as literals, one number for each feature."""
    return {r["feature"]: r["median"] for r in column_medians(df, columns).collect()}


@dataclass(frozen=True)
class OrderCut:
    """The first ``size`` rows of one stratum in an order of several numeric columns.

    ``path`` holds (column, value) pairs: rows strictly before the path belong to
    the cut, and ``ties`` of the rows equal to it on every column do too.
    """

    path: tuple[tuple[str, float], ...]
    ties: int
    n_equal: int

    def before(self) -> Column:
        test = F.lit(False)
        for column, value in reversed(self.path):
            here = F.col(f"`{column}`")
            test = (here < F.lit(value)) | ((here == F.lit(value)) & test)
        return test

    def at(self) -> Column:
        tests = [F.col(f"`{c}`") == F.lit(v) for c, v in self.path]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    @property
    def splits_ties(self) -> bool:
        return 0 < self.ties < self.n_equal

    def taken(self) -> Column:
        """Rows inside the cut, exact unless the cut splits rows that are equal on every column."""
        return self.before() | self.at() if self.ties == self.n_equal else self.before()


def order_cuts(
    df: DataFrame, stratum: str, sizes: dict, order: Sequence[str], limit: int = IN_BRACKET_LIMIT
) -> dict[object, OrderCut]:
    """Cuts after ``sizes[s]`` rows of each stratum ``s``; a few passes, no sort of the rows.

    Only strata whose cut falls among equal values look at the next order column.
    Columns named ``_order...`` hold hashes (see :func:`content_order`).
    """
    open_cuts = {s: OrderCut((), size, -1) for s, size in sizes.items() if size > 0}
    done: dict[object, OrderCut] = {}
    for column in order:
        if not open_cuts:
            break
        inside = reduce(
            lambda a, b: a | b,
            [(F.col(f"`{stratum}`") == F.lit(s)) & cut.at() for s, cut in open_cuts.items()],
        )
        long = df.where(inside).select(
            F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{column}`").cast("double").alias("value")
        )
        waiting = dict(open_cuts)

        def positions(group, n, waiting=waiting):
            return [("cut", min(waiting[group["stratum"]].ties, n) - 1)]

        for row in locate(long, ["stratum"], positions, limit, even=column.startswith("_order")).collect():
            cut = open_cuts.pop(row["stratum"])
            step = OrderCut(
                (*cut.path, (column, row["value"])), cut.ties - row["n_before"], row["n_equal"]
            )
            if step.splits_ties:
                open_cuts[row["stratum"]] = step
            else:
                done[row["stratum"]] = replace(step, ties=step.n_equal)
    return {**done, **open_cuts}


def content_order(df: DataFrame, columns: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Adds two hash columns that order rows repeatably by content; equal only for equal rows."""
    names = [F.col(f"`{c}`") for c in (columns or df.columns)]
    return df.withColumns(
        {"_order_1": order_hash(names, seed), "_order_2": order_hash(names, seed + 7919)}
    )


def numbered(df: DataFrame, order: Sequence[Column], column: str) -> DataFrame:
    """``df`` with each row's place from 0 in ``order``, without one task for all rows.

    Rows are dealt out by ranges of the order; a row's place is its number in its task and the number of rows in the
    tasks before, one number for each task. Rows equal in the order are numbered in any way, and written once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = settle(dealt.withColumn("_part", F.shiftright("_place", 33)), "numbered-rows")
    seen = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_here"))
    before = F.sum("_here").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = seen.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(shifts, "_part").withColumn(column, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def copies(collapsed: DataFrame, count: str, chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``count`` times, spreading one row's copies over many tasks."""
    keep = [F.col(f"`{c}`") for c in collapsed.columns if c != count]
    n = F.col(f"`{count}`")
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / F.lit(chunk)) - 1))
    spread = collapsed.where(n > 0).select(*keep, n.alias("_n"), chunks.alias("_chunk")).repartition("_chunk")
    here = F.least(F.col("_n") - F.col("_chunk") * chunk, F.lit(chunk))
    return spread.select(*keep, F.explode(F.sequence(F.lit(1).cast("long"), here)).alias("_copy")).drop("_copy")
