"""Running totals over the distinct values of long columns, without one big window.

Rows are first reduced to one row for each distinct value. Split points taken
from approximate quantiles cut the value line into buckets of similar row
counts; the running sum is taken inside each bucket, and the totals of the
earlier buckets (one row for each group and bucket) are added afterwards. Any
split points give the same result; they only decide how even the tasks are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.numeric import finite


def split_points(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Interior split points of each column, ascending and distinct."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return {c: [] for c in columns}
    at = [i / parts for i in range(1, parts)]
    found = df.agg(
        *[F.percentile_approx(finite(F.col(f"`{c}`")), at, 10 * parts).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: sorted(set(found[f"c{i}"] or [])) for i, c in enumerate(columns)}


def bucketed_long(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str],
    name: str = "feature",
    parts: int | None = None,
) -> DataFrame:
    """``(keep..., name, bucket, value)`` with finite values only; buckets ascend with the value."""
    points = split_points(df, columns, parts)
    kept = [F.col(f"`{k}`").alias(k) for k in keep]
    wide = df.select(*kept, *[finite(F.col(f"`{c}`")).alias(f"_v{i}") for i, c in enumerate(columns)])
    cut = [i for i, c in enumerate(columns) if points[c]]
    if cut:
        wide = Bucketizer(
            inputCols=[f"_v{i}" for i in cut],
            outputCols=[f"_b{i}" for i in cut],
            splitsArray=[[-float("inf"), *points[columns[i]], float("inf")] for i in cut],
            handleInvalid="keep",
        ).transform(wide)
    parts_of = [
        F.struct(
            F.lit(c).alias(name),
            (F.col(f"_b{i}").cast("int") if i in cut else F.lit(0)).alias("bucket"),
            F.col(f"_v{i}").alias("value"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.array(*parts_of))).where(
        F.col("value").isNotNull()
    )


def running_totals(
    cells: DataFrame, keys: Sequence[str], counts: Sequence[str], descending: bool = False
) -> DataFrame:
    """Adds ``cum_<c>`` for each count: the total over this value and those before it.

    ``cells`` has one row for each ``(keys..., bucket, value)``; its keys are not NULL.
    """
    group = [F.col(f"`{k}`") for k in keys]
    # The join below implies this filter; stated here, both uses of the cells share one shuffle.
    for column in [*group, F.col("bucket")]:
        cells = cells.where(column.isNotNull())
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = (
        Window.partitionBy(*group, "bucket").orderBy(direction("value")).rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy(*group).orderBy(direction("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(*group, "bucket")
        .agg(*[F.sum(c).alias(f"_total_{c}") for c in counts])
        .select(
            *group,
            "bucket",
            *[F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in counts],
        )
    )
    local = cells.select("*", *[F.sum(c).over(inside).alias(f"_local_{c}") for c in counts])
    # Same keys as the window's partitioning, so the join moves no rows of ``local``.
    return local.join(offsets, [*keys, "bucket"]).select(
        *[F.col(f"`{c}`") for c in cells.columns],
        *[(F.col(f"_local_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in counts],
    )


def pair_sums(
    cells: DataFrame, keys: Sequence[str], left: str, others: Sequence[str], additive: dict | None = None
) -> DataFrame:
    """``(keys..., <left>, <o>, <o>_pairs...)``: for each other count, its total and the number of
    (left, other) pairs in which the left value is larger, equal values counting one half.

    Pairs inside a bucket come from the bucket's own running sum; pairs across buckets are a
    product of totals. So one pass over the cells suffices and nothing is joined.
    ``additive`` names further sums over the cells.
    """
    group = [F.col(f"`{k}`") for k in keys]
    inside = (
        Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    additive = additive or {}
    mine = F.col(left).cast("double")
    per_bucket = (
        cells.select("*", *[F.sum(o).over(inside).alias(f"_upto_{o}") for o in others])
        .groupBy(*group, "bucket")
        .agg(
            F.sum(left).alias(left),
            *[F.sum(o).alias(o) for o in others],
            *[F.sum(mine * (F.col(f"_upto_{o}") - F.col(o) / F.lit(2.0))).alias(f"_within_{o}") for o in others],
            *[F.sum(expr).alias(name) for name, expr in additive.items()],
        )
    )
    # From here on there is one row for each group and bucket.
    before = per_bucket.select(
        "*", *[F.coalesce(F.sum(o).over(earlier), F.lit(0)).alias(f"_before_{o}") for o in others]
    )
    return before.groupBy(*group).agg(
        F.sum(left).alias(left),
        *[F.sum(o).alias(o) for o in others],
        *[F.sum(F.col(f"_within_{o}") + mine * F.col(f"_before_{o}")).alias(f"{o}_pairs") for o in others],
        *[F.sum(name).alias(name) for name in additive],
    )
