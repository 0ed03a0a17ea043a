"""Distribution drift between training and test groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions.numeric import finite, percent_shift, ratio
from driftgauge.operators.cumulative import bucketed_long, pair_sums
from driftgauge.operators.metrics import decide
from driftgauge.operators.order_stats import exact_quantiles, locate

TRAIN = "train"


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def feature_moments(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, n, mean, std)`` over finite values, from one aggregation of the wide rows."""
    aggregates = []
    for i, f in enumerate(features):
        value = finite(F.col(f"`{f}`"))
        aggregates += [
            F.count(value).alias(f"n{i}"), F.avg(value).alias(f"m{i}"), F.stddev_samp(value).alias(f"s{i}"),
        ]
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")
        )
        for i, f in enumerate(features)
    ]
    return df.groupBy(*_columns(by)).agg(*aggregates).select(*_columns(by), F.inline(F.array(*rows)))


def group_statistics(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, mean, std, median, q25, q75)``; std with n - 1."""
    quantiles = exact_quantiles(df, features, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)
    keys = [*by, "feature"]
    return feature_moments(df, features, by).join(quantiles, keys, "left").select(
        *_columns(keys), "mean", "std", "median", "q25", "q75"
    )


def shift_long(train: DataFrame, groups: DataFrame, by: str, features: Sequence[str]) -> DataFrame:
    """``(group, feature, train_mean, group_mean, shift_pct)``; shift missing where the train mean is 0."""
    base = feature_moments(train, features).select("feature", F.col("mean").alias("train_mean"))
    means = feature_moments(groups, features, [by]).select(
        F.col(f"`{by}`").cast("string").alias("group"), "feature", F.col("mean").alias("group_mean")
    )
    return means.join(base, "feature").select(
        "group", "feature", "train_mean", "group_mean",
        percent_shift(F.col("group_mean"), F.col("train_mean")).alias("shift_pct"),
    )


def shift_table(shifts: DataFrame, importances: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per feature: importance, train mean, each group's mean and percentage shift."""
    def of(group, column):
        return F.max(F.when(F.col("group") == group, F.col(column)))

    chosen = [
        expr
        for g in groups
        for expr in (of(g, "group_mean").alias(f"{g}_mean"), of(g, "shift_pct").alias(f"{g}_shift_pct"))
    ]
    wide = shifts.groupBy("feature").agg(F.max("train_mean").alias("train_mean"), *chosen)
    return wide.join(importances.select("feature", "importance"), "feature", "left").orderBy(
        F.col("importance").desc_nulls_last(), "feature"
    )


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most important features; names break ties."""
    return importances.orderBy(F.col("importance").desc_nulls_last(), "feature").limit(n)


def top_shifted(shifts: DataFrame, importances: DataFrame, n: int = 10) -> DataFrame:
    """For each group the ``n`` features with the largest absolute shift, ranked."""
    size = F.abs(F.col("shift_pct"))
    place = Window.partitionBy("group").orderBy(size.desc_nulls_last(), "feature")
    return (
        shifts.withColumns({"abs_shift_pct": size, "rank": F.row_number().over(place)})
        .where(F.col("rank") <= n)
        .join(importances.select("feature", "importance"), "feature", "left")
        .select(F.col("group").alias("class"), "feature", "importance", "shift_pct", "abs_shift_pct", "rank")
    )


def drift_report(
    train: DataFrame, test: DataFrame, features: Sequence[str], importances: DataFrame
) -> DataFrame:
    """Mean and median of each feature on both sides, with percentage shifts."""
    def side(df, name):
        stats = feature_moments(df, features).select("feature", F.col("mean").alias(f"{name}_mean"))
        medians = exact_quantiles(df, features, {f"{name}_median": 0.5})
        return stats.join(medians, "feature", "left")

    joined = side(train, "train").join(side(test, "test"), "feature")
    return (
        joined.withColumns(
            {
                "mean_shift_pct": percent_shift(F.col("test_mean"), F.col("train_mean")),
                "median_shift_pct": percent_shift(F.col("test_median"), F.col("train_median")),
            }
        )
        .join(importances.select("feature", "importance"), "feature", "left")
        .orderBy(F.col("importance").desc_nulls_last(), "feature")
    )


def threshold_crossing(df: DataFrame, class_column: str, score: str, threshold: float) -> DataFrame:
    """Rows of each class at or above the threshold, with the class's score summary."""
    name = F.col(f"`{class_column}`").cast("string").alias("attack_class")
    value = df.select(name, finite(F.col(f"`{score}`")).alias("value")).where("value IS NOT NULL")
    sums = value.groupBy("attack_class").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("value") >= threshold).alias("above_threshold"),
        F.avg("value").alias("mean_score"),
        F.max("value").alias("max_score"),
    )
    medians = locate(value, ["attack_class"], lambda _, n: [("median", 0.5 * (n - 1))]).select(
        "attack_class", F.col("value").alias("median_score")
    )
    return sums.join(medians, "attack_class").withColumn(
        "detection_rate", ratio(F.col("above_threshold"), F.col("samples"))
    )


def detection_rates(
    df: DataFrame, class_column: str, scores: dict[str, str], thresholds: dict[str, float]
) -> DataFrame:
    """``(class, samples, <detector>_detection_rate...)`` from one aggregation."""
    rates = [
        F.avg(decide(F.col(f"`{column}`"), thresholds[detector])).alias(f"{detector}_detection_rate")
        for detector, column in scores.items()
    ]
    return df.groupBy(F.col(f"`{class_column}`").cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("samples"), *rates
    )


def detection_vs_shift(shifts: DataFrame, rates: DataFrame) -> DataFrame:
    """Mean absolute feature shift of each class beside its detection rates."""
    mean_shift = shifts.groupBy(F.col("group").alias("class")).agg(
        F.avg(F.abs(F.col("shift_pct"))).alias("mean_abs_feature_shift_pct")
    )
    return rates.join(mean_shift, "class")


def unseen_summary(shifts: DataFrame, rates: DataFrame, order_by: str) -> DataFrame:
    return detection_vs_shift(shifts, rates).orderBy(F.col(order_by).desc_nulls_last(), "class")


#: Fixed value: without ties, samples of which one has at most this many rows have their exact p-value.
EXACT_ROWS = 8
#: Beyond this product of the sample sizes the normal approximation is used all the same.
EXACT_PAIRS = 1 << 24


def exact_tail(n1: int, n2: int, u: int) -> float:
    """P(U <= u) for samples of ``n1`` and ``n2`` untied rows of one distribution.

    U counts the inversions of an arrangement, so the arrangements by U are the coefficients of the Gaussian binomial;
    it is built up factor by factor, as far as ``u`` only.
    """
    few, many = sorted((n1, n2))
    counts = np.zeros(u + 1)
    counts[0] = 1.0
    for i in range(1, few + 1):
        shifted = counts[: max(0, u + 1 - many - i)].copy()
        counts[many + i :] -= shifted  # times 1 - q ** (many + i)
        padded = np.pad(counts, (0, -len(counts) % i)).reshape(-1, i)
        counts = padded.cumsum(axis=0).ravel()[: u + 1]  # over 1 - q ** i
    return float(counts.sum() / math.comb(n1 + n2, few))


@F.pandas_udf(T.DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided exact p-value from the smaller U; one value for each tested feature and group."""
    return pd.Series([None if math.isnan(k) else min(1.0, 2 * exact_tail(int(a), int(b), int(k))) for a, b, k in zip(n1, n2, u)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; one value for each tested feature and group."""
    return z.map(lambda v: None if v is None or math.isnan(v) else min(1.0, math.erfc(v / math.sqrt(2.0))))


def shift_tests(
    train: DataFrame,
    groups: DataFrame,
    by: str,
    features: Sequence[str],
    group_names: Sequence[str],
) -> DataFrame:
    """Mann-Whitney U of training against each group, with effect sizes, on all rows.

    All features and groups share one pass: rows become counts for each distinct
    value, and pairs of ranks are counted from running sums over those counts. ``method`` says how the p-value was
    found: exact where one sample has ``EXACT_ROWS`` rows at most and no value is tied, otherwise by the
    normal approximation with tie and continuity correction.
    """
    side = F.col(f"`{by}`").cast("string")
    both = (
        train.select(*_columns(features), F.lit(-1).alias("_side"))
        .unionByName(
            groups.where(side.isin(*group_names)).select(
                *_columns(features),
                F.coalesce(*[F.when(side == g, F.lit(i)) for i, g in enumerate(group_names)]).alias("_side"),
            )
        )
    )
    counts = [f"g{i}" for i in range(len(group_names))]
    cells = (
        bucketed_long(both, features, ["_side"])
        .groupBy("feature", "bucket", "value")
        .agg(
            F.count_if(F.col("_side") == -1).alias("t"),
            *[F.count_if(F.col("_side") == i).alias(c) for i, c in enumerate(counts)],
        )
    )
    tied = {c: F.col("t").cast("double") + F.col(c) for c in counts}
    ranked = pair_sums(
        cells, ["feature"], "t", counts, {f"{c}_tie": x * x * x - x for c, x in tied.items()}
    ).withColumnRenamed("t", "n1")
    per_group = ranked.select(
        "feature",
        "n1",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(g).alias("group"), F.col(c).alias("n2"),
                        F.col(f"{c}_pairs").alias("u"), F.col(f"{c}_tie").alias("tie"),
                    )
                    for g, c in zip(group_names, counts)
                ]
            )
        ),
    ).where("n1 >= 2 AND n2 >= 2")

    names = F.array(*[F.lit(g) for g in group_names])
    moments = feature_moments(both, features, ["_side"])
    train_side = moments.where("_side = -1").select("feature", F.col("mean").alias("m1"), F.col("std").alias("d1"))
    group_side = moments.where("_side >= 0").select(
        F.get(names, F.col("_side")).alias("group"), "feature", F.col("mean").alias("m2"), F.col("std").alias("d2")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / F.lit(12.0) * (n + 1 - F.col("tie") / (n * (n - 1)))
    larger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    z = (larger - n1 * n2 / F.lit(2.0) - F.lit(0.5)) / F.sqrt(variance)
    pooled = F.sqrt(((n1 - 1) * F.col("d1") ** 2 + (n2 - 1) * F.col("d2") ** 2) / (n - 2))
    tested = (
        per_group.join(train_side, "feature")
        .join(group_side, ["feature", "group"])
        .select(
            "feature",
            "group",
            F.col("n1").alias("n_train"),
            F.col("n2").alias("n_group"),
            F.col("u").alias("mannwhitney_u"),
            F.when(variance > 0, z).alias("z"),
            F.when(
                (F.least("n1", "n2") <= EXACT_ROWS) & (F.col("tie") == 0) & (n1 * n2 <= EXACT_PAIRS), F.least(F.col("u"), n1 * n2 - F.col("u"))
            ).alias("_exact_u"),
            (F.lit(1.0) - ratio(F.col("u") * 2, n1 * n2)).alias("rank_biserial_effect_size"),
            F.when(pooled > 0, (F.col("m2") - F.col("m1")) / pooled).alias("cohens_d"),
        )
    )
    exact = _exact_p("n_train", "n_group", F.col("_exact_u").cast("double"))
    return tested.withColumns({"_exact_p": exact, "_normal_p": _two_sided_p("z")}).select(
        *[c for c in tested.columns if c != "_exact_u"],
        # All values tied: the statistic cannot move, so nothing speaks against equality.
        F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(F.coalesce("_exact_p", "_normal_p")).alias("p_value"),
        F.when(F.col("_exact_p").isNotNull(), "exact").otherwise("normal_approximation").alias("method"),
    )


def significant_shifts(tests: DataFrame, level: float = 0.01) -> DataFrame:
    return tests.agg(F.count_if(F.col("p_value") < level).alias("n_significant"), F.count(F.lit(1)).alias("n_tests"))
