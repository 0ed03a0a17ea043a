"""Detector metrics: confusion counts, threshold grids, ranking quality, per-class results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.numeric import finite, ratio
from driftgauge.operators.cumulative import bucketed_long, running_totals
from driftgauge.operators.order_stats import exact_quantiles, locate
from driftgauge.session import small_table

# The predefined threshold grid and the frozen forest threshold.
THRESHOLD_GRID = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
FOREST_THRESHOLD = 0.01

CONFUSION = ("tn", "fp", "fn", "tp")


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def confusion_counts(truth: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates tn, fp, fn, tp for 0/1 columns; with ``weight`` over pre-counted rows."""
    cases = {
        "tn": (truth == 0) & (predicted == 0),
        "fp": (truth == 0) & (predicted == 1),
        "fn": (truth == 1) & (predicted == 0),
        "tp": (truth == 1) & (predicted == 1),
    }
    if weight is None:
        return [F.count_if(test).alias(name) for name, test in cases.items()]
    return [F.coalesce(F.sum(F.when(test, weight)), F.lit(0)).alias(name) for name, test in cases.items()]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 (0 where undefined) and fpr, fnr (NULL where undefined)."""
    tn, fp, fn, tp = (F.col(c) for c in CONFUSION)
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp, 0.0),
            "recall": ratio(tp, tp + fn, 0.0),
            "f1": ratio(tp * 2, tp * 2 + fp + fn, 0.0),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
        }
    )


def decide(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def threshold_metrics(
    df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    truth, predicted = F.col(f"`{label}`"), decide(F.col(f"`{score}`"), threshold)
    counts = df.groupBy(*_columns(by)).agg(*confusion_counts(truth, predicted))
    return with_rates(counts.withColumn("threshold", F.lit(float(threshold))))


def scores_long(df: DataFrame, scores: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """``(keep..., detector, score)``: one row for each detector's score column."""
    cells = [
        F.struct(F.lit(detector).alias("detector"), finite(F.col(f"`{column}`")).alias("score"))
        for detector, column in scores.items()
    ]
    return df.select(*_columns(keep), F.inline(F.array(*cells)))


def threshold_grid(
    df: DataFrame,
    label: str,
    scores: Mapping[str, str],
    thresholds: Sequence[float] = THRESHOLD_GRID,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row of metrics for each detector and threshold, in a single aggregation.

    A row only contributes the number of thresholds it reaches; the grid is opened
    up after the counts are down to a handful of rows.
    """
    ordered = sorted(set(float(t) for t in thresholds))
    position = {t: i for i, t in reversed(list(enumerate(float(t) for t in thresholds)))}
    long = scores_long(df, scores, [*by, label])
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in ordered), F.lit(0))
    counts = (
        long.where(F.col("score").isNotNull())
        .groupBy(*_columns(by), "detector", F.col(f"`{label}`").alias("_truth"), reached.alias("_reached"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    grid = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.lit(position[t]).alias("grid_pos"), F.lit(i + 1).alias("_needs"))
            for i, t in enumerate(ordered)
        ]
    )
    opened = counts.select("*", F.inline(grid))
    predicted = (F.col("_reached") >= F.col("_needs")).cast("int")
    return with_rates(
        opened.groupBy(*_columns(by), "detector", "threshold", "grid_pos").agg(
            *confusion_counts(F.col("_truth"), predicted, F.col("_rows"))
        )
    )


def select_threshold(grid: DataFrame, metric: str = "f1", by: Sequence[str] = ("detector",)) -> DataFrame:
    """The grid row with the largest metric for each group; the earliest threshold wins ties."""
    best = Window.partitionBy(*_columns(by)).orderBy(F.col(metric).desc_nulls_last(), F.col("grid_pos"))
    return grid.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def score_cells(df: DataFrame, label: str, scores: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score: ``(by..., detector, bucket, value, pos, neg)``."""
    columns = list(scores.values())
    long = bucketed_long(df, columns, [*by, label], name="_column")
    name_of = F.create_map(*[F.lit(v) for d, c in scores.items() for v in (c, d)])
    return (
        long.groupBy(*_columns(by), F.try_element_at(name_of, F.col("_column")).alias("detector"), "bucket", "value")
        .agg(
            F.count_if(F.col(f"`{label}`") == 1).alias("pos"),
            F.count_if(F.col(f"`{label}`") == 0).alias("neg"),
        )
    )


def ranking_quality(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., detector, roc_auc, pr_auc)`` from score cells; NULL where one class is absent.

    ROC-AUC counts tied pairs as one half; PR-AUC is the step-wise average precision.
    """
    keys = [*by, "detector"]
    totals = running_totals(cells, keys, ["pos", "neg"], descending=True)
    higher_or_tied = F.col("cum_neg") - F.col("neg") / F.lit(2.0)
    sums = totals.groupBy(*_columns(keys)).agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
        F.sum(F.col("pos") * higher_or_tied).alias("_lost"),
        F.sum(F.col("pos") * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"), 0.0)).alias("_area"),
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    return sums.select(
        *_columns(keys),
        (F.lit(1.0) - ratio(F.col("_lost"), pairs)).alias("roc_auc"),
        F.when(F.col("_n") > 0, ratio(F.col("_area"), F.col("_p"))).alias("pr_auc"),
    )


def curve_points(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points at each distinct score, with the origin at +Inf."""
    keys = [*by, "detector"]
    totals = running_totals(cells, keys, ["pos", "neg"], descending=True)
    sizes = small_table(cells.groupBy(*_columns(keys)).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    origin = sizes.select(
        *_columns(keys),
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"),
    )
    points = totals.select(
        *_columns(keys),
        F.col("value").alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
    )
    return (
        points.unionByName(origin)
        .join(sizes, keys)
        .select(
            *_columns(keys),
            "threshold",
            "tp",
            "fp",
            ratio(F.col("tp"), F.col("_p")).alias("tpr"),
            ratio(F.col("fp"), F.col("_n")).alias("fpr"),
            ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
            ratio(F.col("tp"), F.col("_p")).alias("recall"),
        )
    )


def _threshold_of(thresholds: Mapping[str, float]) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(v) for d, t in thresholds.items() for v in (d, float(t))]), F.col("detector")
    )


def decision_cells(
    df: DataFrame, label: str, scores: Mapping[str, str], thresholds: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Counts for each ``(by..., detector, truth, decision)``: small, whatever the input size."""
    long = scores_long(df, scores, [*by, label]).where(F.col("score").isNotNull())
    decision = decide(F.col("score"), _threshold_of(thresholds))
    return long.groupBy(
        *_columns(by), "detector", F.col(f"`{label}`").alias("truth"), decision.alias("decision")
    ).agg(F.count(F.lit(1)).alias("rows"))


def comparison_from_cells(
    decisions: DataFrame, cells: DataFrame, thresholds: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    keys = [*by, "detector"]
    counts = decisions.groupBy(*_columns(keys)).agg(
        F.sum("rows").alias("total_samples"),
        F.coalesce(F.sum(F.when(F.col("truth") == 0, F.col("rows"))), F.lit(0)).alias("benign_samples"),
        F.coalesce(F.sum(F.when(F.col("truth") == 1, F.col("rows"))), F.lit(0)).alias("attack_samples"),
        *confusion_counts(F.col("truth"), F.col("decision"), F.col("rows")),
    )
    rated = with_rates(counts).withColumns(
        {"threshold": _threshold_of(thresholds), "attack_detection_rate": F.col("recall")}
    )
    return rated.join(ranking_quality(cells, by), keys, "left")


def compare_detectors(
    df: DataFrame, label: str, scores: Mapping[str, str], thresholds: Mapping[str, float]
) -> DataFrame:
    """One row for each detector: sizes, confusion counts, rates, ROC-AUC and PR-AUC."""
    return comparison_from_cells(
        decision_cells(df, label, scores, thresholds), score_cells(df, label, scores), thresholds
    )


def confusion_matrix(comparison: DataFrame, keys: Sequence[str] = ("detector",)) -> DataFrame:
    """The counts as ``(keys..., actual, predicted, rows)``."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("rows"))
        for c, a, p in (
            ("tn", "benign", "benign"), ("fp", "benign", "attack"),
            ("fn", "attack", "benign"), ("tp", "attack", "attack"),
        )
    ]
    return comparison.select(*_columns(keys), F.inline(F.array(*cells)))


def per_class_results(
    df: DataFrame, class_column: str, scores: Mapping[str, str], thresholds: Mapping[str, float]
) -> DataFrame:
    """Samples, detections and score summary for each detector and class."""
    name = F.col(f"`{class_column}`").cast("string").alias("class")
    long = scores_long(df.withColumn("class", name), scores, ["class"]).where(F.col("score").isNotNull())
    hit = decide(F.col("score"), _threshold_of(thresholds))
    keys = ["detector", "class"]
    sums = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(hit).cast("long").alias("predicted_attack"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
    )
    medians = locate(
        long.withColumnRenamed("score", "value"), keys, lambda _, n: [("median", 0.5 * (n - 1))]
    ).select(*keys, F.col("value").alias("median_score"))
    rate = F.col("predicted_attack") / F.col("samples")
    return (
        sums.join(medians, keys)
        .withColumns(
            {
                "detection_rate": rate,
                "pct_detected": rate * 100.0,
                "pct_missed": (F.lit(1.0) - rate) * 100.0,
            }
        )
        .orderBy("detector", F.col("samples").desc(), "class")
    )


def recall_with_support(
    test: DataFrame, train: DataFrame, class_column: str, score: str, threshold: float
) -> DataFrame:
    """Detection rate of each test class beside its number of training rows."""
    name = F.col(f"`{class_column}`").cast("string").alias("class")
    seen = train.groupBy(name).agg(F.count(F.lit(1)).alias("n_in_train"))
    hits = test.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_in_test"),
        F.avg(decide(F.col(f"`{score}`"), threshold)).alias("recall"),
    )
    return hits.join(seen, "class", "left").withColumn("n_in_train", F.coalesce("n_in_train", F.lit(0)))


def score_summary(df: DataFrame, scores: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each detector's score in each group."""
    renamed = df.select(*_columns(by), *[F.col(f"`{c}`").alias(d) for d, c in scores.items()])
    keys = [*by, "detector"]
    long = scores_long(renamed, {d: d for d in scores}, by).where(F.col("score").isNotNull())
    sums = long.groupBy(*_columns(keys)).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    quartiles = exact_quantiles(renamed, list(scores), {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)
    return sums.join(quartiles.withColumnRenamed("feature", "detector"), keys)


def score_histogram(df: DataFrame, scores: Mapping[str, str], by: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width bins between each group's own extremes, as counts and densities; empty bins kept."""
    keys = [*by, "detector"]
    long = scores_long(df, scores, by).where(F.col("score").isNotNull())
    ends = long.groupBy(*_columns(keys)).agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    # A constant column gets a unit-wide range around its value.
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(
        *_columns(keys), "_n",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    place = F.floor((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    ends = small_table(ends)
    binned = (
        long.join(ends, keys)
        .groupBy(*_columns(keys), F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    frame = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = F.coalesce(F.col("_rows"), F.lit(0))
    return frame.join(binned, [*keys, "bin"], "left").select(
        *_columns(keys),
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("left_edge"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("right_edge"),
        rows.alias("rows"),
        (rows / (F.col("_n") * width)).alias("density"),
    )
