"""Known and unseen classes, and the populations detectors are judged on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators import metrics
from driftgauge.session import literal_table

BENIGN = "Benign"
ALL_ROWS = "all_test"
UNSEEN_ROWS = "unseen_attacks_vs_benign"


def _classes(df: DataFrame, label: str) -> DataFrame:
    if label not in df.columns:
        raise KeyError(f"label column {label!r} not found")
    return df.select(F.col(f"`{label}`").cast("string").alias("class")).where("class IS NOT NULL").distinct()


def class_inventory(train: DataFrame, test: DataFrame, label: str, benign: str = BENIGN) -> DataFrame:
    """``(class, in_train, in_test, role)``; roles: benign, seen_attack, unseen_attack."""
    sides = _classes(train, label).withColumn("side", F.lit("train")).unionByName(
        _classes(test, label).withColumn("side", F.lit("test"))
    )
    flags = sides.groupBy("class").agg(
        F.bool_or(F.col("side") == "train").alias("in_train"), F.bool_or(F.col("side") == "test").alias("in_test")
    )
    role = (
        F.when(F.col("class") == benign, "benign")
        .when(F.col("in_train"), "seen_attack")
        .otherwise("unseen_attack")
    )
    return flags.withColumn("role", role)


def unseen_classes(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Classes of the test side that training never saw, sorted."""
    return _classes(test, label).join(_classes(train, label), "class", "left_anti").orderBy("class")


def collect_unseen(train: DataFrame, test: DataFrame, label: str, benign: str = BENIGN) -> list[str]:
    return [r["class"] for r in unseen_classes(train, test, label).collect() if r["class"] != benign]


def leaked_classes(train: DataFrame, unseen: Sequence[str], label: str) -> DataFrame:
    """Classes called unseen that do occur in training; must be empty."""
    return _classes(train, label).where(F.col("class").isin(*unseen) if unseen else F.lit(False))


def assert_no_unseen_leakage(train: DataFrame, unseen: Sequence[str], label: str) -> None:
    leaked = [r["class"] for r in leaked_classes(train, unseen, label).collect()]
    if leaked:
        raise AssertionError(f"classes called unseen occur in training: {leaked}")


def restrict_unseen(measured: DataFrame, expected: Sequence[str]) -> DataFrame:
    """``(class, expected)``: the expected classes that are really unseen, or all measured ones
    if none of them is; ``all_expected_found`` tells whether the expectation held."""
    wanted = literal_table(measured.sparkSession, [(c,) for c in expected], "class string")
    common = measured.select("class").intersect(wanted)
    n_common = common.agg(F.count(F.lit(1)).alias("n"))
    flagged = measured.select("class").join(common.withColumn("hit", F.lit(True)), "class", "left")
    return (
        flagged.crossJoin(n_common)
        .where(F.col("hit") | (F.col("n") == 0))
        .select("class", (F.col("n") == len(set(expected))).alias("all_expected_found"))
        .orderBy("class")
    )


def population(df: DataFrame, classes: Sequence[str], label: str, benign: str = BENIGN) -> DataFrame:
    """Benign rows and rows of the given classes."""
    return df.where(F.col(f"`{label}`").isin(*classes, benign))


def with_populations(cells: DataFrame, unseen: Sequence[str], label: str, benign: str = BENIGN) -> DataFrame:
    """Repeat pre-aggregated rows for each population their class belongs to.

    Works on counts by class, so the detector scores are scanned once for all populations.
    """
    value = F.col(f"`{label}`")
    is_unseen, is_benign = value.isin(*unseen) if unseen else F.lit(False), value == benign
    belongs = [
        F.lit(ALL_ROWS),
        F.when(is_unseen | is_benign, F.lit(UNSEEN_ROWS)),
        *[F.when(is_benign | (value == c), F.lit(f"unseen__{c}")) for c in unseen],
    ]
    return cells.withColumn("population", F.explode(F.array_compact(F.array(*belongs))))


def compare_populations(
    df: DataFrame,
    label: str,
    class_column: str,
    scores: Mapping[str, str],
    thresholds: Mapping[str, float],
    unseen: Sequence[str],
    benign: str = BENIGN,
) -> DataFrame:
    """Detector comparison on all rows, on benign plus unseen, and on benign plus each unseen class."""
    decisions = with_populations(
        metrics.decision_cells(df, label, scores, thresholds, [class_column]), unseen, class_column, benign
    )
    cells = (
        with_populations(metrics.score_cells(df, label, scores, [class_column]), unseen, class_column, benign)
        .groupBy("population", "detector", "bucket", "value")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    return metrics.comparison_from_cells(decisions, cells, thresholds, ["population"])


def unseen_detection_wide(per_class: DataFrame, prefixes: Mapping[str, str], label: str = "attack_class") -> DataFrame:
    """Per-class results with one pair of columns for each detector."""
    chosen = [
        column
        for detector, prefix in prefixes.items()
        for column in (
            F.max(F.when(F.col("detector") == detector, F.col("predicted_attack"))).alias(f"{prefix}_detected"),
            F.max(F.when(F.col("detector") == detector, F.col("detection_rate"))).alias(f"{prefix}_detection_rate"),
        )
    ]
    return per_class.groupBy(F.col("class").alias(label)).agg(F.max("samples").alias("samples"), *chosen)


def detection_rate_pivot(per_class: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Class by detector table of detection rates."""
    return per_class.groupBy("class").pivot("detector", list(detectors)).agg(F.max("detection_rate"))
