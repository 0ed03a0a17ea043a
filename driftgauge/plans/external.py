"""Frozen evaluation on foreign datasets: nothing is fitted, tuned or estimated on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import names
from driftgauge.operators import drift, evidence, guards, labels, mapping, metrics
from driftgauge.plans.detect import SCORES, Detectors
from driftgauge.session import literal_table
from driftgauge.sources.files import read_external_csv
from driftgauge.sources.sinks import FrozenThresholds, missing_dataset_status
from driftgauge.sources.zeek import read_connection_logs


@dataclass(frozen=True)
class ExternalEvaluation:
    label_mapping: DataFrame
    feature_mapping: mapping.FeatureMapping
    sanitisation: DataFrame
    background: DataFrame | None
    scored: DataFrame
    comparison: DataFrame
    families: DataFrame
    shift_tests: DataFrame | None
    findings: DataFrame


def evaluate_external(
    detectors: Detectors,
    external: DataFrame,
    thresholds: FrozenThresholds,
    label: str | None = None,
    benign_aliases: Sequence[str] = ("benign",),
    background: str | None = None,
    train: DataFrame | None = None,
    n_features: int = 20,
    extra_names: Mapping[str, str] | None = None,
) -> ExternalEvaluation:
    """Label, map onto the frozen features, score and compare. ``background`` names a policy for
    unverified rows; ``train`` switches on drift tests over features that were really mapped."""
    spark = external.sparkSession
    label = label or names.detect_label_column(external.columns)
    if label is None:
        raise ValueError("no label column found in the external table; name it explicitly")
    labels.check_benign_aliases(benign_aliases)
    features, medians = list(detectors.forest.features), detectors.forest.medians
    labelled = labels.family_label(labels.normalize_labels(external, label, benign_aliases))
    table = labels.label_mapping(labelled)
    report = None
    used = labelled
    if background:
        report = labels.background_report(labelled, "label_multiclass_raw", background)
        used = labels.background_policy(labelled, "label_multiclass_raw", background)
    matched = mapping.map_features(features, [c for c in external.columns if c != label], extra_names)
    if not matched.mapped:
        raise ValueError("no feature matches an external column: the tables are not comparable")
    counts = mapping.sanitisation_counts(used, matched, medians)
    mapped = mapping.apply_mapping(used, matched, medians, keep=["label_binary", "family"])
    guards.assert_finite(mapped, features)
    guards.assert_labelled(mapped)
    scored = detectors.score_written(mapped)
    frozen = thresholds.by_detector()
    comparison = metrics.compare_detectors(scored, "label_binary", SCORES, frozen)
    tests = None
    if train is not None:
        top = drift.top_features(detectors.forest.importances(spark), n_features)
        pairs = [(f, e, "mapped") for f, e in matched.mapped.items()]
        known = literal_table(spark, pairs, "feature string, external string, status string")
        testable = [r["feature"] for r in mapping.shiftable_features(top, known).where("testable").collect()]
        if testable:
            group = scored.withColumn("dataset", F.lit("external"))
            tests = drift.shift_tests(train, group, "dataset", testable, ["external"])
    return ExternalEvaluation(
        table, matched, counts, report, scored, comparison,
        metrics.per_class_results(scored, "family", SCORES, frozen),
        tests, evidence.findings(comparison, "f1"),
    )


def evaluate_csv_folder(
    spark: SparkSession, detectors: Detectors, folder: str, thresholds: FrozenThresholds,
    dataset: str = "external", **options,
) -> ExternalEvaluation | DataFrame:
    """The evaluation of a folder of CSV files, or a status record if there are none."""
    external = read_external_csv(spark, folder)
    if external is None:
        return missing_dataset_status(spark, dataset, folder, thresholds)
    return evaluate_external(detectors, external, thresholds, **options)


def evaluate_connection_logs(
    spark: SparkSession, detectors: Detectors, folder: str, thresholds: FrozenThresholds,
    dataset: str = "connection-logs", background: str = "exclude", label: str | None = None, **options,
) -> ExternalEvaluation | DataFrame:
    """The evaluation of connection logs below a folder, or a status record if there are none."""
    logs = read_connection_logs(spark, folder)
    if logs is None:
        return missing_dataset_status(spark, dataset, folder, thresholds)
    if label is None:
        # An exact "label" field beats the general rule.
        label = "label" if "label" in logs.table.columns else names.detect_label_column(logs.table.columns)
    flows, _ = mapping.flow_features_from_connections(logs.table)
    return evaluate_external(detectors, flows, thresholds, label=label, background=background, **options)
