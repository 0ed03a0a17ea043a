"""Training, validation-only threshold selection and frozen evaluation of the three detectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators import evidence, guards, metrics, populations
from driftgauge.operators.forest import ForestDetector, train_forest
from driftgauge.operators.hybrid import HybridConfig, add_hybrid
from driftgauge.operators.isolation import AnomalyDetector, train_isolation_forest
from driftgauge.operators.sampling import benign_heavy_sample
from driftgauge.operators.splits import Split, validation_split
from driftgauge.session import settle
from driftgauge.sources.sinks import FrozenThresholds

SCORES = {"random_forest": "rf_score", "isolation_forest": "anomaly_score", "hybrid": "hybrid_score"}


@dataclass(frozen=True)
class Detectors:
    """Fitted models only: stages that take this cannot retrain anything."""

    forest: ForestDetector
    anomaly: AnomalyDetector
    hybrid: HybridConfig

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and feature columns with the three scores, computed once and written."""
        features = list(self.forest.features)
        narrow = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *features])])
        return self.score_written(narrow)

    def score_written(self, df: DataFrame) -> DataFrame:
        """:meth:`score_rows`, written once: without a frozen range the scaling has written all but a projection."""
        rows = self.score_rows(df)
        frozen = self.anomaly.low is not None and self.anomaly.high is not None
        return settle(rows, "scored") if frozen else rows

    def score_rows(self, df: DataFrame) -> DataFrame:
        return add_hybrid(self.anomaly.score(self.forest.score(df)), self.hybrid)


def train_detectors(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label_binary",
    row_key: Sequence[str] | str | None = None,
    forest_options: dict | None = None,
    sample_options: dict | None = None,
    anomaly_options: dict | None = None,
    hybrid: HybridConfig = HybridConfig(),
) -> Detectors:
    guards.assert_features_present(features, train=train)
    guards.assert_labelled(train, label)
    forest = train_forest(train, features, label, **(forest_options or {}))
    sample = benign_heavy_sample(train, features, label=label, row_key=row_key, **(sample_options or {}))
    anomaly = train_isolation_forest(sample, row_key=row_key, **(anomaly_options or {}))
    return Detectors(forest, anomaly, hybrid)


@dataclass(frozen=True)
class Selection:
    grid: DataFrame
    selected: DataFrame
    thresholds: FrozenThresholds


def select_thresholds(scored_validation: DataFrame, label: str = "label_binary") -> Selection:
    """Grid and best threshold of each detector on validation rows only. The forest's own pick is
    reported; what is frozen for it is the fixed constant."""
    grid = metrics.threshold_grid(scored_validation, label, SCORES)
    selected = metrics.select_threshold(grid)
    picked = {r["detector"]: r["threshold"] for r in selected.select("detector", "threshold").collect()}
    frozen = FrozenThresholds(
        metrics.FOREST_THRESHOLD, picked["isolation_forest"], picked["hybrid"], "validation_selection"
    )
    return Selection(grid, selected, frozen)


@dataclass(frozen=True)
class Evaluation:
    validation: Split
    selection: Selection
    scored_test: DataFrame
    comparison: DataFrame
    per_class: DataFrame
    unseen: list[str]
    alerts: DataFrame


def evaluate(
    detectors: Detectors,
    train: DataFrame,
    test: DataFrame,
    label: str = "label_binary",
    class_column: str = "label_multiclass",
    keep: Sequence[str] = (),
    benign: str = "Benign",
) -> Evaluation:
    """Pick thresholds on the validation days, freeze them, then judge the test rows once."""
    features = list(detectors.forest.features)
    guards.assert_feature_alignment(features, detectors.anomaly.features, "anomaly detector")
    guards.assert_labelled(test, label)
    validation = validation_split(train)
    selection = select_thresholds(detectors.score(validation.test, [label]), label)
    scored = detectors.score(test, [label, class_column, *keep])
    thresholds = selection.thresholds.by_detector()
    return Evaluation(
        validation,
        selection,
        scored,
        metrics.compare_detectors(scored, label, SCORES, thresholds),
        metrics.per_class_results(scored, class_column, SCORES, thresholds),
        # Judged against the whole training period, not the sub-training days.
        populations.collect_unseen(train, test, class_column, benign),
        evidence.alerts(
            scored, features, thresholds["random_forest"], thresholds["hybrid"], keep=list(keep)
        ),
    )
