"""Explanations of the frozen detectors and the evidence built from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators import evidence, explain
from driftgauge.operators.sampling import balanced_sample
from driftgauge.plans.detect import Detectors
from driftgauge.session import settle
from driftgauge.sources.sinks import FrozenThresholds

# Sample sizes of the explanation stage.
BASE_SAMPLE, SHAP_SAMPLE, PERMUTATION_SAMPLE, ANOMALY_SAMPLE = 10_000, 2_000, 5_000, 2_000


@dataclass(frozen=True)
class Explanations:
    shap: DataFrame
    builtin: DataFrame
    permutation: DataFrame
    comparison: DataFrame
    anomaly: DataFrame
    forest_local: DataFrame
    anomaly_local: DataFrame
    evidence: DataFrame


def explain_detectors(
    detectors: Detectors,
    scored_test: DataFrame,
    thresholds: FrozenThresholds,
    row_key: str,
    label: str = "label_binary",
    dataset: str = "test",
    provenance: Mapping[str, str] | None = None,
    n_mapped: int = 9,
    n_imputed: int = 49,
) -> Explanations:
    spark = scored_test.sparkSession
    base = settle(balanced_sample(scored_test, label, BASE_SAMPLE, row_key=row_key), "explained")

    def part(n):
        return balanced_sample(base, label, n, row_key=row_key)

    shap = explain.forest_global(detectors.forest, part(SHAP_SAMPLE)).withColumn("shap_rank", F.col("rank"))
    builtin = detectors.forest.importances(spark).withColumnRenamed("importance", "rf_builtin_importance")
    permutation = settle(
        explain.permutation_importance(
            detectors.forest, part(PERMUTATION_SAMPLE), row_key, thresholds.forest, label
        ),
        "permutation",
    )
    forest_local = explain.forest_local(
        detectors.forest, scored_test, row_key, thresholds.forest, label, dataset=dataset
    )
    anomaly_local = explain.anomaly_local(
        detectors.anomaly, scored_test, row_key, thresholds.anomaly, label, dataset=dataset
    )
    weights = {"rf": detectors.hybrid.forest_weight, "anomaly": detectors.hybrid.anomaly_weight}
    joined = forest_local.unionByName(anomaly_local, allowMissingColumns=True)
    return Explanations(
        shap,
        builtin,
        permutation,
        explain.importance_comparison(shap, builtin, permutation),
        explain.anomaly_global(detectors.anomaly, part(ANOMALY_SAMPLE)),
        forest_local,
        anomaly_local,
        evidence.evidence_records(
            joined, thresholds.forest, thresholds.anomaly, thresholds.hybrid, weights, provenance, n_mapped, n_imputed
        ),
    )
