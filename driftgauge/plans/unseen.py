"""Evaluation of attack classes that training never saw, and their drift."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators import drift, evidence, guards, metrics, populations
from driftgauge.plans.detect import SCORES, Detectors
from driftgauge.sources.sinks import FrozenThresholds

PREFIXES = {"random_forest": "RF", "isolation_forest": "IF", "hybrid": "hybrid"}


@dataclass(frozen=True)
class UnseenEvaluation:
    inventory: DataFrame
    unseen: list[str]
    comparison: DataFrame
    per_class: DataFrame
    wide: DataFrame
    findings: DataFrame


def evaluate_unseen(
    detectors: Detectors,
    train: DataFrame,
    scored_test: DataFrame,
    thresholds: FrozenThresholds,
    label: str = "label_binary",
    class_column: str = "label_multiclass",
    benign: str = "Benign",
) -> UnseenEvaluation:
    guards.assert_feature_alignment(detectors.forest.features, detectors.anomaly.features, "anomaly detector")
    unseen = populations.collect_unseen(train, scored_test, class_column, benign)
    populations.assert_no_unseen_leakage(train, unseen, class_column)
    if not unseen:
        raise ValueError("every test class occurs in training: there is nothing unseen to evaluate")
    frozen = thresholds.by_detector()
    comparison = populations.compare_populations(scored_test, label, class_column, SCORES, frozen, unseen, benign)
    only_unseen = scored_test.where(F.col(f"`{class_column}`").isin(*unseen))
    per_class = metrics.per_class_results(only_unseen, class_column, SCORES, frozen)
    judged = comparison.where(F.col("population") == populations.UNSEEN_ROWS)
    return UnseenEvaluation(
        populations.class_inventory(train, scored_test, class_column, benign),
        unseen,
        comparison,
        per_class,
        populations.unseen_detection_wide(per_class, PREFIXES),
        evidence.findings(judged, "recall", margin=0.05),
    )


@dataclass(frozen=True)
class DriftAnalysis:
    features: list[str]
    shifts: DataFrame
    shift_table: DataFrame
    top_shifted: DataFrame
    detection_vs_shift: DataFrame
    crossing: DataFrame
    tests: DataFrame
    summary: DataFrame


def analyse_drift(
    detectors: Detectors,
    train: DataFrame,
    scored_test: DataFrame,
    thresholds: FrozenThresholds,
    expected_unseen: Sequence[str] = (),
    class_column: str = "label_multiclass",
    benign: str = "Benign",
    n_features: int = 20,
    n_shifted: int = 10,
) -> DriftAnalysis:
    """Feature drift of the benign rows and of each unseen class against training."""
    spark = train.sparkSession
    importances = detectors.forest.importances(spark)
    features = [r["feature"] for r in drift.top_features(importances, n_features).collect()]
    measured = populations.unseen_classes(train, scored_test, class_column).where(F.col("class") != benign)
    chosen = populations.restrict_unseen(measured, expected_unseen) if expected_unseen else measured
    unseen = [r["class"] for r in chosen.collect()]
    groups = [benign, *unseen]
    rows = scored_test.where(F.col(f"`{class_column}`").isin(*groups))
    shifts = drift.shift_long(train, rows, class_column, features)
    frozen = thresholds.by_detector()
    attack_shifts = shifts.where(F.col("group").isin(*unseen))
    rates = drift.detection_rates(
        scored_test.where(F.col(f"`{class_column}`").isin(*unseen)), class_column, SCORES, frozen
    )
    return DriftAnalysis(
        features,
        shifts,
        drift.shift_table(shifts, importances, groups),
        drift.top_shifted(attack_shifts, importances, n_shifted),
        drift.detection_vs_shift(attack_shifts, rates),
        drift.threshold_crossing(rows, class_column, "hybrid_score", frozen["hybrid"]),
        drift.shift_tests(train, rows, class_column, features, groups),
        drift.unseen_summary(attack_shifts, rates, "random_forest_detection_rate"),
    )
